"""Token ids of whole texts by a public tokenizer, with a bounded memory of the units already encoded.

A text is cut only where the tokenizer itself always cuts: before a space that follows a character which is
not white space. The ids of the units in order are the ids of the text, so each distinct unit is encoded once
per worker while it stays in memory. For byte-level files most texts split into pre-tokens outright, by one pattern over the text. The memory holds two generations of bounded size, which changes the speed and never the ids.
A text that holds the string of an added token (``<|endoftext|>``) is encoded as a whole by the library.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: White space that the tokenizers' patterns may take together with a following space.
_RUN = re.compile(r"[\s᠎​] ")
_CUT = re.compile(r"(?<![\s᠎​])(?= )")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_P = "!\"#$%&()*+,./:;<=>?@\\[\\]^_`{|}~-"
#: Units of Latin-1 letters, ASCII punctuation (no apostrophe) and single line ends between them: the pieces
#: are the pre-tokens of either tokenizer, and stable under NFC.
_SIMPLE = re.compile(f"[{_L}{_P}](?:[{_L}{_P}]|\n(?=[{_L}{_P}]))*").fullmatch
_PIECES = re.compile(f"[{_L}]+|[{_P}]+|\n").findall
#: Whole texts of letters, digits and punctuation of ASCII, Latin-1 letters, spaces, tabs and line ends: the pieces below are
#: the byte-level pre-tokens of such a text.
_FLAT = re.compile(f"[{_L}0-9!-/:-@\\[-`{{-~ \\t\n]*").fullmatch
_PRETOKENS = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|[ \\t\n]+(?![^ \\t\n])|[ \\t\n]+").findall
UNITS = 360_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stay, the others follow from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers, those of the library's plain call without
    special tokens added around the text; an added token's string inside a text becomes that token's id, as there.
    ``spaced``: a unit's ids depend on the space before it (byte-level files); else white space is dropped and
    letters are lower-cased (word files)."""

    def __init__(self, path: str, spaced: bool, units: int = UNITS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.spaced, self.units = self.tok.model, spaced, units
        self.symbols = byte_symbols()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.known: dict[str, bytes] = {}  # units and first pieces
        self.inner: dict[str, bytes] = {}  # later pieces of a unit
        self.flat: dict[str, bytes] = {}  # pre-tokens of plain texts
        self.old_flat: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # the generation before

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tok.encode(text, add_special_tokens=False).ids))

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _piece(self, piece: str, first: bool) -> tuple[bytes, bool]:
        """Ids of one pre-token, and whether it was known."""
        key = piece
        young, old = (self.known, self.old[0]) if first else (self.inner, self.old[1])
        ids = young.get(piece)
        if ids is not None:
            return ids, True
        ids = old.get(piece)
        seen = ids is not None
        if ids is None:
            if not self.spaced:
                piece = piece.lower()  # Latin-1 letters only
            if piece.isascii() and piece != "\n":
                s = ("Ġ" + piece if first else piece) if self.spaced else piece
            elif self.spaced or piece != "\n":
                s = "".join(map(self.symbols.__getitem__, (" " + piece if self.spaced and first else piece).encode()))
            else:
                s = ""  # white space has no ids in word files
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(s)]) if s else b""
        young[key] = ids
        return ids, seen

    def _unit(self, unit: str) -> bytes:
        """A unit not in memory; it is kept as a whole once its pieces are known."""
        ids = self.old[0].get(unit)
        if ids is not None:
            self.known[unit] = ids
        elif _SIMPLE(unit):
            pieces = _PIECES(unit)
            got = [self._piece(p, first=not i) for i, p in enumerate(pieces)]
            ids = b"".join([x for x, _ in got])
            if len(got) > 1 and all(seen for _, seen in got):
                self.known[unit] = ids
        else:
            ids = self.whole((" " + unit) if self.spaced else unit)
            if len(unit) <= 64:
                self.known[unit] = ids
        return ids

    def _flat(self, text: str) -> bytes:
        """A text of the plain alphabet by its pre-tokens."""
        pieces = _PRETOKENS(text)
        out = list(map(self.flat.get, pieces))
        if None in out:
            flat, old, symbols, packed, tokenize = self.flat, self.old_flat, self.symbols, self.packed, self.model.tokenize
            for i, ids in enumerate(out):
                if ids is None:
                    p = pieces[i]
                    ids = flat.get(p) or old.get(p)
                    if ids is None:
                        ids = b"".join([packed[t.id] for t in tokenize("".join(map(symbols.__getitem__, p.encode())))])
                    if len(p) <= 64:
                        flat[p] = ids
                    out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self._holds_added(text):
            return self.whole(text)
        if self.spaced and _FLAT(text):
            if len(self.flat) > self.units:
                self.old_flat, self.flat = self.flat, {}
            return self._flat(text)
        if len(self.known) + len(self.inner) > self.units:
            self.old, self.known, self.inner = (self.known, self.inner), {}, {}
        first = b""
        if self.spaced:
            units = [u[1:] for u in _CUT.split(text)[1:]] if _RUN.search(text) else text.split(" ")[1:]
            head = text[:len(text) - sum(map(len, units)) - len(units)]
            first = self.whole(head) if head else b""
        else:
            try:
                text.encode("latin-1")
                low = text.lower()
                if self._holds_added(low):
                    return self.whole(text)  # lower-casing must not make an added token
                text = low
            except UnicodeEncodeError:
                pass  # the tokenizer normalises units outside Latin-1 itself
            units = text.split(" ")
        out = list(map(self.known.get, units))
        if None in out:
            unit = self._unit
            out = [unit(u) if ids is None else ids for u, ids in zip(units, out)]
        return first + b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker process and file, kept over tasks."""
    return Encoder(path, spaced)
