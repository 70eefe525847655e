"""Token ids of a public byte-level BPE vocabulary.

Texts of common Latin characters go through the same vocabulary's rank file in
``tiktoken``, which gives the ids of ``tokenizers`` five times as fast (held
against it in the tests); all others, and texts with the special token's
string, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable

import numpy as np

#: Beyond these the two libraries may hold different Unicode tables; `<|` begins a special token.
ODD = re.compile("[^\u0000-ɏ‐-‧€]|<\\|")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=1)
def whole(path: str):
    """The tokenizer itself; loaded at the first text that needs it, as it takes some 100 MB."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32); ``path``: the tokenizer's json, with the rank file beside it if there is one."""
    path = path or vocabulary("byte_bpe_50k.json")

    def slow(text: str) -> np.ndarray:
        return np.array(whole(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if not text.isascii() and ODD.search(text) or "<|" in text:
            return slow(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode
