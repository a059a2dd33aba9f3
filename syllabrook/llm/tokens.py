"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The vocabulary used unless another is named: byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a file of ranks (one base64 token and its rank a line)."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def size(text: str, vocabulary: str = VOCABULARY) -> int:
    """Number of tokens of a text."""
    return len(encoder(vocabulary).encode_ordinary(text))


def parts(text: str, limit: int, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """A text as parts of at most ``limit`` tokens: (start, end, tokens) in code points; whole if it is within the limit.

    Cuts lie between tokens and never inside a character, as late as the limit allows.
    """
    code = encoder(vocabulary)
    ids = code.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts_char = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char)])
    ends = np.cumsum([len(code.decode_single_token_bytes(i)) for i in ids])
    # code points up to each token's end where a character ends there, else -1
    whole = np.append(starts_char, True)[ends]
    out, start, at = [], 0, 0
    while at < len(ids):
        stop = min(at + limit, len(ids))
        while True:
            while stop > at + 1 and not whole[stop - 1]:
                stop -= 1
            end = int(chars[ends[stop - 1]])
            n = len(code.encode_ordinary(text[start:end]))
            if n <= limit or stop == at + 1:
                break
            stop -= n - limit  # a part read by itself may fall into more tokens
        out.append((start, end, n))
        start, at = end, stop
    return out
