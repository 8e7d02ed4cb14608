"""Ids of a public tokenizer, word by word with a bounded cache.

The tokenizer drops white space and never joins what white space parts, so a text's ids are those
of its chunks between ASCII white space, one after another. Chunks of plain Latin letters, digits
and signs are cut into the pre-tokens of the vocabulary file's own pattern and given to the
library's model; every other chunk goes through the library's whole ``encode``. A vocabulary file with
another normaliser or pre-tokenizer has its texts encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: The normaliser and pre-tokenizer for which texts may be cut as below.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """Chunk (bytes) -> its ids as little-endian bytes.

    Of two generations with ``most`` entries at most, the older is dropped when the younger is full.
    """

    def __init__(self, path: str | None = None, most: int = 100_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path or vocabulary_path())
        parts = json.loads(self.whole.to_str())
        self.known = parts["normalizer"] == NORMALIZER and (parts["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] == SPLIT
        self.model, self.most, self.old = self.whole.model, most, {}
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.char = "H" if self.kind.itemsize == 2 else "I", _byte_chars()

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(self.char[b] for b in piece.encode())
        return self.pack([t.id for t in self.model.tokenize(mapped)])

    def fresh(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # letters in ASCII, lower-cased or not: one pre-token
            low = chunk.lower()
            return self.word(low.decode()) if low == chunk else self[low]
        if chunk[-1:] in b",.!" and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1:]]
        text = chunk.decode("utf-8", "replace")
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        pieces = _PIECES.findall(text.lower())
        if len(pieces) == 1 and pieces[0] == text:
            return self.word(text)
        return b"".join([self[piece.encode()] for piece in pieces])

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.fresh(chunk)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if not self.known:
            return self.pack(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if b"<|" not in text:  # lower-casing might make a special token of what isn't one
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))

    def wide(self, ids: bytes) -> bytes:
        """The same ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(ids, self.kind).astype("<u4").tobytes()


_held: dict[str, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    """One encoder for each Python worker and vocabulary file."""
    path = path or vocabulary_path()
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]
