"""Hashes of normalised lines, shared by line dedup and the quality rules.

A normalised line is its words (runs of characters other than \\x20 and
\\x09-\\x0D), A-Z lower-cased, joined by single spaces. Lines are what \\n splits.
"""

from __future__ import annotations

import xxhash

SEED = 42


def line_hash(words: list[bytes]) -> int:
    """Signed XXH64 of a normalised line given by its lower-cased words."""
    h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return h - (1 << 64) if h >> 63 else h


def hashed_lines(text: bytes, least_words: int = 1) -> list[tuple[int, int]]:
    """(hash, words) of every line with at least so many words, in order."""
    found = []
    for line in text.lower().split(b"\n"):
        words = line.split()
        if len(words) >= least_words:
            found.append((line_hash(words), len(words)))
    return found
