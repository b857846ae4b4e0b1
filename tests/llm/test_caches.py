import pyarrow as pa

from ligneo.llm.tokens import ENCODERS, default_tokenizer, encoded
from ligneo.llm.words import HASHES, word_hashes


def test_work_frees_the_caches_of_other_work():
    before = word_hashes("One word, two words").tolist()
    assert HASHES
    ids = [i.tolist() for i in encoded(pa.array(["some text", None]), default_tokenizer(), 0)]
    assert not HASHES and ENCODERS
    assert word_hashes("One word, two words").tolist() == before
    assert [i.tolist() for i in encoded(pa.array(["some text", None]), default_tokenizer(), 0)] == ids


def test_work_without_a_cache_frees_all():
    from ligneo.llm.common import forget_others

    word_hashes("a word")
    list(encoded(pa.array(["some text"]), default_tokenizer(), 0))
    forget_others("tokens")
    assert not HASHES and ENCODERS
    forget_others()
    assert not ENCODERS
