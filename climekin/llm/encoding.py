"""Exact tokenizer encodings, with a bounded cache of text pieces.

The tokenizers library decides every id.  Texts are cut only where the
tokenizer itself always cuts, so that each piece can be encoded on its own
and frequent pieces are encoded once for each worker process:

* byte-level BPE: at a single space or line feed between two characters that
  are not white space.  The split pattern starts a new piece at such a space
  and makes such a line feed a piece of its own.
* word BPE whose split pattern drops white space: at spaces and line feeds.

A piece of letters of Basic Latin and Latin-1 with marks after it is the
piece of its letters and that of its marks, and letters alone go straight to
the library's BPE model, since no step before it changes them further.

A text that holds the string of an added token is encoded whole.  A test
compares every cut against the library on the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array

import numpy as np

#: Entries of one cache; a full cache is emptied.
CACHE_ENTRIES = 500_000
#: Longer pieces are not kept.
CACHE_CHARS = 64

_AWKWARD = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Marks that are neither letter, number, white space nor part of a contraction.
_PLAIN = re.compile(rf"([{_LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)\Z")


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = __import__("json").loads(self.tokenizer.to_str())
        added = [t["content"] for t in config["added_tokens"]]
        self._added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        pre, norm = config["pre_tokenizer"] or {}, config["normalizer"]
        byte_level = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        words = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
            and "\\s" in first["pattern"].get("Regex", "")
        )
        self._kind = "bytes" if byte_level else "words" if words else "whole"
        # What the byte-level step makes of single characters.
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._shown = {c: step.pre_tokenize_str(chr(c))[0][0] for c in [32, *range(33, 127), *range(0xC0, 0x100)]}
        self._model = self.tokenizer.model
        self._bare, self._spaced = _Pieces(self._piece), _Pieces(self._spaced_piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, text: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(text.translate(self._shown))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = _PLAIN.match(piece)
        if not plain:
            return self._whole(piece)
        letters, marks = plain.groups()
        if self._kind == "words":
            letters = letters.lower()
        if marks:
            return self._bare[letters] + self._bare[marks]
        return self._letters(letters) if letters == piece else self._bare[letters]

    def _spaced_piece(self, piece: str) -> bytes:
        plain = _PLAIN.match(piece)
        if not plain:
            return self._whole(" " + piece)
        letters, marks = plain.groups()
        return self._spaced[letters] + self._bare[marks] if marks else self._letters(" " + letters)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._kind == "whole" or self._added is not None and self._added.search(text):
            return self._whole(text)
        if self._kind == "words":
            bare = self._bare
            return b"".join([bare[p] for p in text.replace("\n", " ").split(" ") if p])
        bare, spaced, newline = self._bare, self._spaced, self._bare["\n"]
        if _AWKWARD.search(text):
            cut = _CUT.split(text)
            out = [bare[cut[0]]]
            for sep, piece in zip(cut[1::2], cut[2::2]):
                out.append(spaced[piece] if sep == " " else newline + bare[piece])
            return b"".join(out)
        out = []
        for line in text.split("\n"):
            parts = line.split(" ")
            out.append(bare[parts[0]] + b"".join(map(spaced.__getitem__, parts[1:])))
        return newline.join(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


@functools.lru_cache(maxsize=4)
def pieces(path: str):
    """A sentencepiece model, one for each worker process and file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counter(path: str):
    """A function text -> number of tokens, for a .json or .model file."""
    if path.endswith(".model"):
        model = pieces(path)
        return lambda text: len(model.encode(text)) if text else 0
    encode = encoder(path).encode
    return lambda text: len(encode(text)) // 4


def file_digest(path: str) -> str:
    """Version of a tokenizer: SHA-256 of its file and the library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(library).__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {version}".encode()).hexdigest()
