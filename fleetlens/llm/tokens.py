"""Token ids by a public tokenizer file, with a bounded cache of the pieces between which no merge can happen.

A byte-level or word-level BPE splits a text into pieces by a fixed pattern and merges inside a piece only, so the ids
of a text are those of its pieces in order. For texts within Latin letters (all below U+0180) the pattern is written
out with explicit letter classes and each distinct piece is tokenised once per worker by the tokenizers library's
model; any other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .common import cache_of, take_turn

#: The Latin letters and numbers below U+0180.
_L = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_BYTE_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Characters that send a text to the library whole.
_ODD = re.compile(r"[^\t\n\r -~¡-įĲ-ſ]")
_CACHE_BYTES = 64 << 20


def _byte_chars() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class TokenIds:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype`` (uint16 if the vocabulary allows, else uint32): those of the library
    without special tokens added. The string of a special token in a text gives that token's id, as the library has it by default, or is
    ordinary text if ``plain``."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        spec = json.loads(self.tok.to_str())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.kind = None  # no known pattern: every text goes to the library whole
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                self.kind = "byte"
            elif kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and "]+|[\\p{N}]|" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
                self.kind = "word"
        special = [t["content"].lower() for t in spec.get("added_tokens", []) if t["content"] and not (plain and t["special"])]
        self.opening = os.path.commonprefix(special)  # of all strings that are a token as a whole
        if special and not self.opening:
            self.kind = None
        self.cased = self.opening.upper() != self.opening
        self.chars = _byte_chars()
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.kind is None or _ODD.search(text) or (self.opening and self.opening in (text.lower() if self.cased else text)):
            return self._whole(text)
        if self.kind == "byte":
            pieces = _BYTE_PIECE.findall(text)
        else:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            pieces = _WORD_PIECE.findall(text.lower())
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        if self.held > _CACHE_BYTES:
            cache.clear()
            self.held = 0
        tokenize, chars, dtype = self.model.tokenize, self.chars, self.dtype
        for p in pieces:
            if p not in cache:
                ids = [t.id for t in tokenize(p.encode().decode("latin-1").translate(chars))]
                cache[p] = b = np.array(ids, dtype=dtype).tobytes()
                self.held += 110 + len(b) + len(p)
        return b"".join([cache[p] for p in pieces])


_loaded: dict[tuple[str, bool], TokenIds] = {}
cache_of("tokens", lambda: _loaded.clear())


def token_ids(path: str, plain: bool = False) -> TokenIds:
    """One instance per worker process and file."""
    take_turn("tokens")
    if (path, plain) not in _loaded:
        _loaded[path, plain] = TokenIds(path, plain)
    return _loaded[path, plain]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
