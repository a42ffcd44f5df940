"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from functools import cache

import numpy as np

#: the id that ends a document
END = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that ``tokenizers`` gives without special tokens; their strings in a text are ordinary text.

    tiktoken, whose ranks are the same ids, encodes a text in one call. A text with two spaces in a row or with the
    string of a special token goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for a null or empty text."""
        if not text:
            return np.zeros(0, "<u4")
        if "  " in text or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        text = text.encode("utf-8", "replace").decode("utf-8")  # a lone surrogate would stop tiktoken
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def document(self, text: str | None) -> np.ndarray:
        """Ids and then END."""
        return np.append(self.encode(text), np.array([END], "<u4"))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``capacity`` but the first, which takes what remains."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []
