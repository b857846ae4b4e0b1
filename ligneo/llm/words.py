"""Hashed words and word shingles of whole texts."""

from string import punctuation

import numpy as np
import xxhash

from ligneo.llm.common import kept_for, mix64

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
NO_WORD = 0


class WordHashes(dict):
    """64-bit hash of a token: lower case, without marks at its ends; a token of marks alone is no word."""

    def __missing__(self, token):
        word = token.lower()
        if not word.isalnum():
            word = word.strip(punctuation)
            if word and not (word[0].isalnum() and word[-1].isalnum()):  # marks beyond ASCII
                letters = [i for i, c in enumerate(word) if c.isalnum()]
                word = word[letters[0]:letters[-1] + 1] if letters else ""
        value = (xxhash.xxh64_intdigest(word) or 1) if word else NO_WORD
        if len(self) < 200_000:
            self[token] = value
        return value


HASHES = kept_for("words", WordHashes())


def token_hashes(text):
    """Hashes of the white-space separated tokens of a text, NO_WORD for marks."""
    tokens = text.split()
    return np.fromiter(map(HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def word_hashes(text):
    hashes = token_hashes(text)
    return hashes[hashes != NO_WORD]


def shingles(words, k):
    """Hashes of all runs of k words; fewer than k words are one run; no words have none."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    if k > 16:  # differences of running sums, with the power of the first word taken out again: the same numbers, whatever k
        powers, inverses = (np.full(len(words), f, dtype=np.uint64) for f in (FACTOR, INVERSE))
        powers[0] = inverses[0] = 1
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * np.multiply.accumulate(powers), out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * np.multiply.accumulate(inverses)[:len(words) - k + 1])
    total, power = np.zeros(len(words) - k + 1, dtype=np.uint64), 1
    for j in range(k):
        total += words[j:len(words) - k + 1 + j] * np.uint64(power)
        power = power * FACTOR % (1 << 64)
    return mix64(total)
