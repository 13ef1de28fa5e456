"""Token ids of a byte-level BPE tokenizer, packed as little-endian bytes.

A text is cut by the tokenizer's own pre-token pattern and each distinct pre-token is encoded once for a worker
by the tokenizers library; the ids of a text are then one join of byte strings. Texts with characters whose
class in the pattern may differ between Unicode versions, or with a special token's string, are encoded whole by
the library, so the ids are always the library's."""

from __future__ import annotations

import json
import struct
from functools import cached_property

import numpy as np
import regex

PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Blocks whose characters have had one class for many versions: Latin, punctuation, currency signs.
STABLE = regex.compile(r"[\u0000-ɏ‐-‧‰-⁞€]*")


class Encoder(dict):
    """pre-token -> its ids as bytes, in two generations of half of `most` each."""

    def __init__(self, json_text: str, most: int = 400_000):
        super().__init__()
        parsed = json.loads(json_text)
        self.json, self.special = json_text, [t["content"] for t in parsed.get("added_tokens", [])]
        self.size = 1 + max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens", []))])
        self.old: dict = {}
        self.most, self.single = most, _by_rank(parsed["model"])

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, made when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            found = self.single(piece) if self.single else None
            ids = self.whole(piece) if found is None else struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if 2 * len(self) >= self.most:  # the older half goes; what is used again comes back from it
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if (not text.isascii() and not STABLE.fullmatch(text)) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PATTERN.findall(text)))


def _by_rank(model: dict):
    """A faster encoder of single pre-tokens, by the vocabulary as ranks; None unless merges are in the order of their
    ids, which makes both ways of merging the same."""
    import tiktoken

    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or model.get("dropout") or model.get("ignore_merges"):
        return None
    # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    known = set(merged)
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token) and (len(token) == 1 or i in known)}
    if len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
