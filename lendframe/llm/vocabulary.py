"""The public byte-level vocabulary that operators with token ids use. Its path is a parameter; nothing is copied."""

from __future__ import annotations

import base64
import os
from functools import cache

import tiktoken

RANKS = os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: The published word pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def tokenizer(path: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding("public_50k", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def token_bytes(path: str = RANKS) -> list[bytes]:
    """Bytes of each id: all that decoding needs, without the matcher's memory."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out
