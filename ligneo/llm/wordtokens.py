"""Token ids of whole texts by a tokenizer that drops white space, with a bounded cache of words per worker.

Such a tokenizer treats what lies between two spaces alone: its normalization joins nothing across a space and its pieces hold
none. So the ids of a text are those of its segments between spaces, one after the other. Arrow finds the distinct segments of many
texts; those of plain letters with marks after them are looked up as word and marks. The library itself encodes whatever is
not known yet. `check_tokenizer` refuses a tokenizer of which this is not true.
"""

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ligneo.llm.tokens import SPELLING, chunks

MARKS = ".,;:!?"  # never part of a contraction or of an added token's content
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = f"^[{LETTERS}]+$"
PROBES = ("Word", "abcxyz", "ÀÞïÿßµ", "a b", "a  b", " a", "a ", "Ab c.", "a .", "'s 's", "1 2", "é ́x", "a\tb c")


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spelled(word):
    """A word of Latin-1 letters as a byte-level vocabulary spells it."""
    return word.lower().encode().decode("latin-1").translate(SPELLING)


class Segments(dict):
    """Bytes of the ids of a segment, asked of the library at first sight; a segment of plain letters is one word of its model."""

    def __init__(self, library, earlier=None):
        super().__init__()
        self.library, self.earlier = library, earlier or {}
        self.tokenize = library.model.tokenize

    def __missing__(self, segment):
        data = self.earlier.get(segment)
        if data is None:
            if segment.isalpha() and max(segment) <= "ÿ":
                ids = [t.id for t in self.tokenize(spelled(segment))]
            else:
                ids = self.library.encode(segment, add_special_tokens=False).ids
            data = array("I", ids).tobytes()
        self[segment] = data
        return data

    def aged(self, most):
        """Itself, or, if it is full, an empty successor that knows this generation and no earlier one."""
        return Segments(self.library, dict(self)) if len(self) > most else self


def check_tokenizer(library):
    """Raise for a tokenizer that does not treat segments between spaces alone, by probes and its added tokens."""
    ids = lambda text: library.encode(text, add_special_tokens=False).ids
    apart = all(ids(p) == [i for s in p.split(" ") for i in ids(s)] for p in PROBES)
    apart = apart and all(ids(p) == [t.id for t in library.model.tokenize(spelled(p))] for p in PROBES if p.isalpha())
    if not apart or any(" " in t.content or t.lstrip or t.rstrip for t in library.get_added_tokens_decoder().values()):
        raise ValueError("this tokenizer keeps white space")


class SegmentEncoder:
    def __init__(self, path, most=400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        check_tokenizer(self.library)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.marked = not any(re.search(f"[A-Za-zÀ-ÿ][{MARKS}]|[{MARKS}]$", a) for a in added)  # marks can be taken off
        self.known = Segments(self.library)

    def segments(self, distinct):
        """Bytes of the ids of each segment of an Arrow array, as an array of objects."""
        words = pc.ascii_rtrim(distinct, characters=MARKS) if self.marked else distinct
        plain = pc.match_substring_regex(words, PLAIN)
        whole = pc.if_else(plain, words, distinct).dictionary_encode()
        ids = np.empty(len(whole.dictionary), dtype=object)
        ids[:] = list(map(self.known.__getitem__, whole.dictionary.to_pylist()))
        data = ids[whole.indices.to_numpy()]
        marked = pc.and_(plain, pc.not_equal(words, distinct))
        if pc.any(marked).as_py():
            after = pc.replace_substring_regex(distinct.filter(marked), f"^[{LETTERS}]+", "").dictionary_encode()
            marks = np.empty(len(after.dictionary), dtype=object)
            marks[:] = [self.known[m] for m in after.dictionary.to_pylist()]
            data[marked.to_numpy(zero_copy_only=False)] += marks[after.indices.to_numpy()]
        return data

    def encode(self, texts):
        """One array of unsigned 32-bit ids per text of an Arrow array without nulls."""
        self.known = self.known.aged(self.most)
        parts = pc.split_pattern(texts, pattern=" ")
        ends = parts.offsets.to_numpy()
        segments = parts.flatten().dictionary_encode()
        place = segments.indices.to_numpy()
        data = self.segments(segments.dictionary)
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        ids, starts = np.frombuffer(b"".join(data), dtype="<u4"), np.cumsum(lengths) - lengths
        n = lengths[place]
        upto = np.cumsum(n)
        whole = ids[np.repeat(starts[place] - upto + n, n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], upto])[ends - ends[0]].tolist()
        for begin, end in zip(cuts, cuts[1:]):
            yield whole[begin:end]


ENCODERS = {}


def encoded(column, path, end_id, most_bytes=8_000_000):
    """Yield the ids of each text of an Arrow column, null as empty, with the end id."""
    if path not in ENCODERS:
        ENCODERS[path] = SegmentEncoder(path)
    end = np.array([end_id], dtype="<u4")
    for texts in chunks(column, most_bytes):
        for ids in ENCODERS[path].encode(texts):
            yield np.concatenate([ids, end])
    pa.default_memory_pool().release_unused()
