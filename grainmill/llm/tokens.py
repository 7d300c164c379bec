"""Token counts and offsets of a public byte-level tokenizer, inside Arrow workers."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The vocabulary file; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this tokenizer cuts a text into words before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a worker, read once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """Length in bytes of each token."""
    enc = encoder(path)
    out = np.zeros(enc.n_vocab + 1, np.int64)
    for i in enc._mergeable_ranks.values():
        out[i] = len(enc.decode_single_token_bytes(i))
    return out


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> np.ndarray:
    """Tokens of whole texts; NULL has none."""
    enc = encoder(path)
    return np.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], np.int64)
