"""The cached encoder gives the ids of the library for whole texts."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from ligneo.llm.tokens import TextEncoder, chunks, default_tokenizer

ALPHABET = [" ", "  ", "\n", "a", "Bc", "é", "ß", ".", ",", "!!", "'s", "1", "23", "\t", "|", "***", "日本", "\r", " ", "<|endoftext|>", "😀",
            "\x1c", "\x85", "ll", "'", "-", "×", "ª", "²", "\\", "]", "^"]
PLAIN = [" ", "\n", "a", "Bc", "é", "ß", ".", ",", "!!", "'s", "1", "23", "|", "***", "ll", "'", "-", "\\", "]", "^", " ", " "]


def test_ids_equal_the_library_on_random_texts():
    own, draw = TextEncoder(default_tokenizer(), most=50), random.Random(1)
    for alphabet in (ALPHABET, PLAIN):
        texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
        expected = [x.ids for x in own.library.encode_batch(texts, add_special_tokens=False)]
        assert [list(ids) for ids in own.encode(pa.array(texts))] == expected
        assert [list(ids) for ids in own.encode(pa.array(["", *texts]).slice(1))] == expected


def test_frequent_words_survive_a_full_cache():
    own = TextEncoder(default_tokenizer(), most=20)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    for i in range(0, 300, 10):
        text = "the " + " the ".join(words[i:i + 10])
        assert list(next(own.encode(pa.array([text])))) == own.library.encode(text, add_special_tokens=False).ids
    assert len(own.words) <= 40


def test_chunks_hold_all_texts():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c" * 3] * 7)
    found = [t for part in chunks(column, 20) for t in part.to_pylist()]
    assert found == [t or "" for t in column.to_pylist()]
    assert list(chunks(pa.array([], pa.string()), 20)) == []


def test_added_tokens_are_those_of_a_freshly_loaded_library():
    library, own, draw = Tokenizer.from_file(default_tokenizer()), TextEncoder(default_tokenizer()), random.Random(2)
    alphabet = [*PLAIN, "<|endoftext|>", "<|endoftext", "|>", "x<|endoftext|>y"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain words only", "", *("".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(2000))]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    assert [list(ids) for ids in own.encode(pa.array(texts))] == expected
    assert [list(ids) for ids in own.encode(pa.array(["", *texts]).slice(1))] == expected
