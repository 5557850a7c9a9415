"""Token ids by a byte-level BPE vocabulary, whole texts at a time, for use inside Arrow functions.

The vocabulary file is the tokenizers library's; its merge order equals its id order, so the same ids come from a rank
table, whose encoder hands back arrays without making Python integers. Strings of special tokens get their own ids, as
the library gives them.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers


def default_vocab() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if it prints, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(vocab: str):
    """The encoder of a vocabulary file; built once a worker."""
    import tiktoken

    letters = byte_letters()
    with open(vocab, encoding="utf-8") as f:
        whole = json.load(f)
    model, special = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"] if t["special"]}
    merged = {a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special and (len(token) == 1 or token in merged)}
    return tiktoken.Encoding("kinloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, vocab: str) -> np.ndarray:
    """The ids (uint32) of a text; of null, none."""
    return encoder(vocab).encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


def decode(ids, vocab: str) -> str:
    return encoder(vocab).decode(list(map(int, ids)))
