"""Byte-level BPE ids: the plain merges of one library wherever they are those of the other, which counts."""

from __future__ import annotations

import base64
import json
from functools import cached_property, lru_cache

import numpy as np


def u32(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


class ByteEncoder:
    """Ids as the tokenizers library gives them, special tokens in a text included."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str) -> None:
        import tiktoken

        self._file = tokenizer_file
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(tokenizer_file, encoding="utf-8") as f:
            self._special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def _whole(self):  # noqa: ANN202  a tokenizers.Tokenizer
        """The library's own tokenizer: few texts need it, so it is loaded by the first that does."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self._file)
        found.no_truncation()
        found.no_padding()
        return found

    def __call__(self, text: str) -> bytes:
        # Both libraries class the letters of Latin scripts alike; beyond them only the one counts.
        if not text or max(text) < "ɐ" and not any(s in text for s in self._special):
            return u32(self._plain.encode_ordinary(text))
        return u32(self._whole.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=1)
def byte_encoder(tokenizer_file: str, ranks_file: str, pattern: str) -> ByteEncoder:
    """Once in each Python process."""
    return ByteEncoder(tokenizer_file, ranks_file, pattern)
