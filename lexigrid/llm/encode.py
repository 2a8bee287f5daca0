"""Encoding of whole texts with the tokenizers library, through a bounded cache of words.

A text is cut only where the tokenizer's own pre-tokens end (between letters or digits and other
marks, and before the blanks that open a word), so the pieces' ids, put together, are the whole
text's ids. Texts with other white space than blanks and line ends, texts that hold the string of an
added token (such as <|endoftext|>), and tokenizers of an unknown make, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from struct import pack

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
from tokenizers import Tokenizer

_ODD = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")
_ODD_BYTES = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_GLUED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OPEN = re.compile(r"[ \n]*[^\W_]+|[ \n]*(?:[^\w \n]|_)+|[ \n]+")
_BARE = re.compile(r"[^ \n]+")
_SHUT = re.compile(r"[^\W_]+|(?:[^\w \n]|_)+")
#: The printable stand-ins that byte-level tokenizers use for the bytes of a word.
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Words kept per generation; of two generations the older goes when the younger is full.
CACHE = 600_000


class _Words(dict):
    """ids of pieces as bytes, found on first sight."""

    def __init__(self, tokenizer: Tokenizer, lower: bool):
        self.model, self.tokenizer, self.lower, self.old = tokenizer.model.tokenize, tokenizer, lower, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            body = piece[1:] if piece[0] == " " else piece
            if body.isalpha() and (body.isascii() or max(body) <= "\u00ff") and not (self.lower and len(body) < len(piece)):
                # one pre-token: straight to the library's model
                word = body.lower() if self.lower else body
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTES)
                if len(body) < len(piece):
                    word = "Ġ" + word
                found = [t.id for t in self.model(word)]
            else:
                found = self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = pack(f"<{len(found)}I", *found)
            if len(piece) > 40:
                return ids
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """ids of texts as little-endian unsigned 32-bit arrays in bytes.

    The strings of special tokens become those tokens, as the library does of itself; with special_as_text they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path) as f:
            conf = json.load(f)
        pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
        self.kind = ""
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "open"
        elif "[^\\s\\p{L}\\p{N}]+" in json.dumps(pre).replace("\\\\", "\\") and norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "shut"
        added = [t for t in conf.get("added_tokens") or [] if t.get("content") and not (special_as_text and t.get("special"))]
        self.added = [t["content"] for t in added]
        if any(t.get("normalized") for t in added):
            self.kind = ""  # sought in the normalised text, which isn't known here
        self.words = _Words(self.tokenizer, self.kind == "shut")

    def pieces(self, text: str) -> list[str] | None:
        """The text in pieces that no pre-token crosses, nothing left out; None where the library must see it whole."""
        if self.kind != "open":
            return None
        return self._cut(text)

    def _cut(self, text: str) -> list[str] | None:
        try:
            raw = text.encode("latin-1")
            plain, odd = True, len(raw.translate(None, _ODD_BYTES)) < len(raw)
        except UnicodeEncodeError:
            plain, odd = False, _ODD.search(text)
        if odd or not self.kind or any(x in text for x in self.added):
            return None
        fine = plain and "'" not in text
        if self.kind == "open":
            return (_OPEN if fine else _GLUED).findall(text)
        return _SHUT.findall(text.lower()) if fine else _BARE.findall(text)

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = self._cut(text)
        if pieces is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This process's encoder for a vocabulary file; it lives as long as the Python worker."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
