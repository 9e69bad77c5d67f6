"""Whole texts to token ids with a public tokenizer file, in Arrow batches.

The byte-level tokenizer encodes each piece of its pre-tokenizer's pattern by
itself, and no piece reaches over a space that a visible character follows. So
a text is cut at such spaces, and each part's ids are kept as bytes; a new
part is cut into pieces by the pattern, and only new pieces go through the
merges of the tokenizers library's model, in its byte alphabet. A text is the
join of its parts' bytes. A text that holds the string of an added token (such
as ``<|endoftext|>``) is encoded by the library whole. The caches are bounded and only save time; a task
may make them last for the next one.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

CACHE_PARTS, CACHE_PIECES = 700_000, 100_000

#: The byte alphabet: bytes that print stand for themselves, the others for the code points from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.piecewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and sys.byteorder == "little"
        added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        if self.piecewise:
            import public_tokenizers

            self.pieces = regex.compile(public_tokenizers.PATTERN).findall
            self.blank = re.compile(r" (?=\s|\Z)").search
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.merge = self.tokenizer.model.tokenize
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.most_parts = CACHE_PARTS
        self.parts: dict[str, bytes] = {}  # the ids of a space and what follows it, by what follows
        self.cache: dict[str, bytes] = {}  # of pieces that are no space and letters

    def _merged(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.kind, [x.id for x in self.merge(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece's ids; a space and letters are a part by themselves."""
        word = piece[1:]
        cache, key = (self.parts, word) if piece[0] == " " and word.isalpha() else (self.cache, piece)
        if (got := cache.get(key)) is None:
            if cache is self.cache and len(cache) >= CACHE_PIECES:
                cache.clear()
            got = cache[key] = self._merged(piece)
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as the library's plain ``encode(text, add_special_tokens=False)`` gives them."""
        if not self.piecewise:
            return [np.array(x.ids, dtype=self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # The strings of added tokens are found before any piece is: a text that holds one goes to the library whole.
        return [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype=self.dtype) if self.holds_added(x) else np.frombuffer(self._bytes(x), dtype=self.dtype) for x in texts]

    def _bytes(self, text: str) -> bytes:
        head, *parts = [text] if self.blank(text) else text.split(" ")
        known = self.parts
        new = set(parts).difference(known)
        if len(known) + 2 * len(new) > self.most_parts:
            known.clear()
            new = set(parts)
        for x in new:
            known[x] = self._merged(" " + x) if x.isalpha() else b"".join(map(self._piece, self.pieces(" " + x)))
        return b"".join(map(self._piece, self.pieces(head))) + b"".join(map(known.__getitem__, parts))

    def forget(self) -> None:
        """Empty the caches, so that an idle worker keeps no memory for them."""
        self.cache, self.parts = {}, {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; a task that is done with it makes it ``forget``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
