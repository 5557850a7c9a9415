"""64-bit hashes of words (the lower half of MD5, which SQL engines have too) for use inside Arrow functions.

The lowest bit isn't the hash's: it says whether the word ends in a full stop, exclamation or question mark. The cache is
bounded and affects speed only.
"""

from __future__ import annotations

from hashlib import md5

MOST = 150_000
ENDS = (b".", b"!", b"?")


class Hashes(dict):
    """word (bytes) to its hash; a miss computes it."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(md5(word, usedforsecurity=False).digest()[8:], "little") & ~1 | (word[-1:] in ENDS)
        if len(self) < MOST:
            self[word] = h
        return h


HASHES = Hashes()
