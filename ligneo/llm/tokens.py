"""Token ids of whole texts by a public byte-level tokenizer, with a bounded cache of words per worker."""

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ligneo.llm.common import forget_others, kept_for

# Over these characters alone the pieces below are exactly the tokenizer's own pre-tokens; a text with any other character,
# or with white space this leaves unmatched, or with an added token of the tokenizer's, goes to the library as a whole.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n(?!\n)")
TRIMMED = ".,;:!?|*&$%#"
# Byte-level vocabularies spell bytes that are no visible Latin-1 characters as the characters from 256 on, in order.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLING = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - VISIBLE))}


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words(dict):
    """Bytes of the ids of the pre-token `lead + word`, asked of the library's model at first sight."""

    def __init__(self, tokenize, lead="", earlier=None):
        super().__init__()
        self.tokenize, self.lead, self.earlier = tokenize, lead, earlier or {}

    def __missing__(self, word):
        data = self.earlier.get(word)
        if data is None:
            whole = self.lead + word
            if whole.isascii():
                spelled = whole.replace(" ", "Ġ").replace("\n", "Ċ")
            else:
                spelled = whole.encode().decode("latin-1").translate(SPELLING)
            data = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        self[word] = data
        return data

    def aged(self, most):
        """Itself, or, if it is full, an empty successor that knows this generation and no earlier one."""
        return Words(self.tokenize, self.lead, dict(self)) if len(self) > most else self


class TextEncoder:
    """Ids of texts exactly as the library gives them for the whole text.

    The ids of a text are those of its pre-tokens, one after the other, and a pre-token never holds a space after another
    character. So a text is cut at its spaces. Arrow finds the distinct segments of many texts and takes marks off their ends;
    what is left is mostly words, whose ids are kept, in two generations of `most` entries each, so that frequent ones stay.
    Other segments are cut into pieces one by one. A text with a segment that the pieces do not cover or with the content of an
    added token, which the library finds before it cuts, goes to the library as a whole.
    """

    def __init__(self, path, most=200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Added tokens are cut out of a text before anything else, so a text that holds one goes to the library as a whole.
        added = sorted({t.content for t in self.library.get_added_tokens_decoder().values() if t.content})
        self.added = "|".join(map(re.escape, added))
        self.most = most
        tokenize = self.library.model.tokenize
        self.pieces, self.words = Words(tokenize), Words(tokenize, " ")

    def cut(self, whole):
        """Bytes of the ids of a segment, None if the pieces do not cover it."""
        pieces = PIECES.findall(whole)
        return b"".join(map(self.pieces.__getitem__, pieces)) if sum(map(len, pieces)) == len(whole) else None

    def segments(self, distinct):
        """Bytes of the ids of each segment of an Arrow array with a space before it."""
        words = pc.ascii_rtrim(distinct, characters=TRIMMED)
        marks = pc.subtract(pc.binary_length(distinct), pc.binary_length(words))
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$")
        known = words.filter(plain).dictionary_encode()
        data = np.empty(len(distinct), dtype=object)
        ids = np.empty(len(known.dictionary), dtype=object)
        ids[:] = list(map(self.words.__getitem__, known.dictionary.to_pylist()))
        is_plain = plain.to_numpy(zero_copy_only=False)
        data[is_plain] = ids[known.indices.to_numpy()]
        marked = np.flatnonzero(is_plain & (marks.to_numpy() > 0))
        for i, n, segment in zip(marked.tolist(), marks.to_numpy()[marked].tolist(), distinct.take(pa.array(marked)).to_pylist()):
            data[i] += self.pieces[segment[-n:]]
        others = np.flatnonzero(~is_plain)
        for i, segment in zip(others.tolist(), distinct.take(pa.array(others)).to_pylist()):
            data[i] = self.cut(" " + segment)
        return data.tolist()

    def encode(self, texts):
        """One array of unsigned 32-bit ids per text of an Arrow array without nulls."""
        self.words, self.pieces = self.words.aged(self.most), self.pieces.aged(self.most)
        parts = pc.split_pattern(texts, pattern=" ")
        ends = parts.offsets.to_numpy()
        ends, begins = ends[1:] - ends[0], ends[:-1] - ends[0]
        segments = parts.flatten().dictionary_encode()
        place = segments.indices.to_numpy().astype(np.int64)
        firsts = segments.dictionary.take(pa.array(place[begins])).to_pylist()
        data = self.segments(segments.dictionary)
        place[begins] = np.arange(len(data), len(data) + len(firsts))
        data += [self.cut(f) for f in firsts]
        odd = np.array([d is None for d in data])
        holds_added = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), dtype=bool)
        data = [d or b"" for d in data]
        ids, lengths = np.frombuffer(b"".join(data), dtype="<u4"), np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        starts = np.cumsum(lengths) - lengths
        for i, (begin, end) in enumerate(zip(begins, ends)):
            own = place[begin:end]
            if holds_added[i] or odd[own].any():
                yield np.asarray(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
            else:
                n = lengths[own]
                upto = np.cumsum(n)
                yield ids[np.repeat(starts[own] - upto + n, n) + np.arange(upto[-1])]


ENCODERS = kept_for("tokens", {})


def encoder(path):
    """One encoder per worker process and tokenizer file."""
    if path not in ENCODERS:
        ENCODERS[path] = TextEncoder(path)
    return ENCODERS[path]


def chunks(column, most_bytes):
    """Runs of the texts of an Arrow column of some megabytes each, null as empty; a longer text is a run of its own."""
    texts = column.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        held = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, held + most_bytes, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def encoded(column, path, end_id, most_bytes=8_000_000):
    """Yield the ids of each text of an Arrow column, null as empty, with the end id."""
    forget_others("tokens")
    own, end = encoder(path), np.array([end_id], dtype="<u4")
    for texts in chunks(column, most_bytes):
        for ids in own.encode(texts):
            yield np.concatenate([ids, end])
    pa.default_memory_pool().release_unused()
