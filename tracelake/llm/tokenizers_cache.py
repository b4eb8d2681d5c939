"""Public tokenizers, loaded once in each Python worker."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np


SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def byte_ranks(vocabulary: str) -> dict[bytes, int]:
    """The bytes of every token of a byte-level BPE, with its id."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=8)
def byte_bpe(vocabulary: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Text to ids of a byte-level BPE, exactly as the tokenizers library gives them for the .json
    file; the .tiktoken file holds the same vocabulary as ranks, which encodes faster.

    ``special``: the end-of-text string inside a text is that special token, as the library's default
    has it; else it is ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = byte_ranks(vocabulary)
    own = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    allowed = {SPECIAL} if special else set()
    return lambda text: own.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


@lru_cache(maxsize=4)
def piece_model(model: str):
    """A sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
