"""A byte-level BPE tokenizer file, taken apart into pre-tokens and their pieces.

The library loads the file and gives the pieces of a pre-token; a text's pre-tokens come from the same pattern as the
library's, or, for texts with rare characters (whose classes differ between Unicode versions), from the library itself.
Strings of added tokens inside a text become those tokens, as the library does by default.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

_RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘-”•…€]")
#: Fixed value: the pattern of byte-level pre-tokens, over the characters that are not rare: their letters, numbers and white space, spelt out.
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PLAIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\t\n\r {_LETTER}{_DIGIT}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
_MOST = 600_000


class ByteBpe:
    """Pre-tokens of texts and the ids of pre-tokens; ids of recent pre-tokens are kept, a bounded number of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        kind = stated["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or stated["normalizer"]:
            raise ValueError("only byte-level BPE without a prefix space or normalizer is taken apart here")
        self.library = Tokenizer.from_file(path)
        self.added = {x["content"]: x["id"] for x in stated["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._find = re.compile(PLAIN).findall
        self.size = self.library.get_vocab_size()
        # Bytes stand as characters in the file's vocabulary: printable ones as themselves, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._bytes = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self._space = chr(self._bytes[32])
        self._tokenize = self.library.model.tokenize
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self._ids = _Ids(self)

    def pretokens(self, text: str) -> list[str]:
        """The text in order, cut into pre-tokens and strings of added tokens."""
        if self._split and self._split.search(text):
            return [y for x in self._split.split(text) if x for y in ([x] if x in self.added else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _RARE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._find(text)

    def pieces(self, pretokens: list[str]) -> list[int]:
        """How many ids each pre-token has."""
        tokenize = self._pieces
        return [1 if x in self.added else len(tokenize(x)) for x in pretokens]

    def _pieces(self, pretoken: str) -> list:
        if pretoken.isascii() and pretoken.isprintable():  # of these bytes, only the space is shown as another character
            return self._tokenize(pretoken.replace(" ", self._space))
        return self._tokenize(pretoken.encode().decode("latin-1").translate(self._bytes))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of type `kind`. Pre-tokens not known yet are encoded once."""
        if len(self._ids) > _MOST:
            self._ids = _Ids(self)
        known = self._ids.__getitem__
        return [b"".join(map(known, self.pretokens(x))) for x in texts]


class _Ids(dict):
    """Ids of pre-tokens as bytes, each made when first asked for."""

    def __init__(self, tokens: ByteBpe):
        self.pieces, self.code = tokens._pieces, "H" if tokens.kind == "<u2" else "I"
        super().__init__({x: array(self.code, [i]).tobytes() for x, i in tokens.added.items()})

    def __missing__(self, pretoken: str) -> bytes:
        ids = self[pretoken] = array(self.code, [t.id for t in self.pieces(pretoken)]).tobytes()
        return ids


@functools.lru_cache(2)
def load(path: str) -> ByteBpe:
    """One instance for each worker process and file."""
    return ByteBpe(path)
