"""Token ids of whole texts from a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np

#: White space in one run beyond which texts go to the tokenizers library: tiktoken's pattern overflows its stack near a million.
LONG_BLANK = 100_000


def default_vocabulary() -> str:
    """The rank file of byte_bpe_50k.json; encoding from it takes a fifth of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizers_file(path: str) -> str:
    """The tokenizers file beside a rank file."""
    return path.removesuffix(".tiktoken") + ".json"


def declared_tokens(path: str) -> dict[str, int]:
    """The added tokens that a tokenizers file declares: its tokenizer finds them in any text. No file, no tokens."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"{t['content']} is not matched as it stands")
    return {t["content"]: t["id"] for t in added}


def has_long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text))


class Encoder:
    """Ids as the vocabulary's tokenizer gives them; strings of added tokens are ordinary text where none are named."""

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.path, self.added, self.slow = path, added, None
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.array(self._slow(t) if has_long_blank(t) else self.encoding.encode(t, allowed_special="all"), np.uint32) for t in texts]

    def _slow(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(tokenizers_file(self.path))
            self.slow.encode_special_tokens = not self.added
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def declared_encoder(path: str) -> Encoder:
    """The encoder of a rank file with the added tokens of the tokenizers file beside it, as that file gives ids by default."""
    return Encoder(path, declared_tokens(tokenizers_file(path)))
