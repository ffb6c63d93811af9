"""Vocabulary files of public tokenizers: where they are, and what is built from them once a worker."""

from __future__ import annotations

import base64
from functools import lru_cache


def default_path(name: str) -> str:
    """Place of an installed public vocabulary file. Every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, _, rank = line.partition(b" ")
            found[base64.b64decode(token)] = int(rank)
    return found
