"""Whole-text tokenisation with a public tokenizer file, piece by piece.

Neither public tokenizer merges across a plain space or line feed, so a text's
ids are the ids of its pieces one after another: for the byte-level one a piece
is a word with the space before it, a line feed, or a bare word after a line
feed; the one that drops white space takes words. Texts with any other white
space (tabs, runs, Unicode spaces) are cut at safe places only. Pieces not met
lately are encoded together, as one text in which a separator of known ids
stands between them, and kept in a dictionary of bounded size.
:class:`PieceEncoder` gives exactly the ids of ``Tokenizer.encode`` of the
whole text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array

import numpy as np

from quarry.llm import blocks as B

CACHE_PIECES = 600_000  # of one generation; two are kept
JOINED = 200
SPACE = "\u0120"  # a space in byte-level vocabularies
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit integers")

# A space between two characters that are certainly no white space: printable
# ASCII and Latin letters.
_PLAIN_SPACE = re.compile("(?<=[!-~À-ÿ])(?= (?<=[!-~À-ÿ] )[!-~À-ÿ])")
_ASCII_SPACE = re.compile("[ \\t\\n\\r\\x0b\\x0c]+")
_UNICODE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x00")


def _is_plain(text: str) -> bool:
    """Only single spaces and line feeds, between other characters."""
    if any(odd in text for odd in _ODD) or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.isascii() or _UNICODE_SPACE.search(text) is None


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, in two
    generations: a full one is put aside and asked before encoding anew."""

    def __init__(self, tokenizer, gap: str, mark: str, lowers: bool):
        super().__init__()
        self.tokenizer, self.gap, self.mark, self.lowers = tokenizer, gap, mark, lowers
        self.old: dict = {}
        self.limit = CACHE_PIECES
        self.stop = self._ids(mark)

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
        return ids

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def join(self, cuts: list[list]) -> list[bytes]:
        """The ids of each list of pieces; unknown pieces are learned together."""
        pieces = [p for cut in cuts for p in cut]
        ids = list(map(self.__getitem__, pieces))
        if None in ids:
            holes = [i for i, x in enumerate(ids) if x is None]
            self._learn({pieces[i] for i in holes})
            for i in holes:
                ids[i] = self[pieces[i]]
        if len(self) > self.limit:
            self.old = {}  # let go before the copy: two generations at a time, never three
            self.old = dict(self)
            self.clear()
        out, at = [], 0
        for cut in cuts:
            out.append(b"".join(ids[at:at + len(cut)]))
            at += len(cut)
        return out

    def _learn(self, pieces: set) -> None:
        """Encode unknown pieces. A full stop or comma after a letter is a word of
        its own to both tokenizers, so such a piece is its stem and the sign."""
        ended = [p for p in pieces if p[-1] in ".," and p[-2:-1].isalpha()]
        if ended:
            self._learn_all({p[:-1] for p in ended if p[:-1] not in self}.union(pieces.difference(ended), {".", ","}))
            for p in ended:
                self[p] = self[p[:-1]] + self[p[-1]]
        else:
            self._learn_all(pieces)

    def _learn_all(self, pieces: set) -> None:
        # ASCII words are one unit to the pre-tokenizers and pass them unchanged
        # but for the space before them, so the file's merges apply directly.
        merge = self.tokenizer.model.tokenize
        rest = []
        for p in pieces:
            word = p[1:] if p[:1] == " " else p
            if word.isascii() and word.isalpha() and (not self.lowers or word.islower()):
                self[p] = array("I", [t.id for t in merge(p if word is p else SPACE + word)]).tobytes()
            else:
                rest.append(p)
        plain = [p for p in rest if self.mark not in p]
        pieces = set(rest)
        for p in pieces.difference(plain):
            self[p] = self._ids(p).tobytes()
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = ["".join(p + self.gap for p in g) for g in groups]
        for group, enc in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(enc.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.stop[0]) if len(self.stop) == 1 else ()
            if len(ends) != len(group):
                for p in group:
                    self[p] = self._ids(p).tobytes()
                continue
            raw, at = ids.tobytes(), (4 * ends).tolist()
            for p, lo, hi in zip(group, [0, *(x + 4 for x in at)], at):
                self[p] = raw[lo:hi]


class PieceEncoder:
    """Encodes texts to little-endian 32-bit id bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        self.drops_space = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps)
        keeps_lead = steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not conf.get("normalizer")
        if not (self.drops_space or keeps_lead):
            raise ValueError("unknown pre-tokenizer: pieces can't be encoded one by one")
        # Lower-casing Latin-1 texts first is what this normaliser does anyway.
        norm = conf.get("normalizer") or {}
        self.lowers = self.drops_space and any(n.get("type") == "Lowercase" for n in norm.get("normalizers", [norm]))
        # Separators: a bar between spaces, and a line feed; a piece that holds
        # the mark itself is encoded alone.
        self.pieces = _Pieces(tok, " | ", "|", self.lowers) if self.drops_space else _Pieces(tok, "\n", "\n", False)

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.drops_space:
            if self.lowers and _is_latin(text):
                text = text.lower()
            if _is_plain(text):
                return text.replace("\n", " ").split(" ")
            return [p for p in _ASCII_SPACE.split(text) if p]
        if _is_plain(text):
            return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return _PLAIN_SPACE.split(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text. (The collector would walk the dictionary again and
        again and find nothing: pieces and ids form no cycles.)"""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.pieces.join([self._cut(t) for t in texts])
        finally:
            if on:
                gc.enable()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, PieceEncoder] = {}
B.CACHES.append(_ENCODERS)


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder per worker process and file, which keeps twice ``cache_pieces``
    pieces at most."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].pieces.limit = cache_pieces
    return _ENCODERS[path]


def public_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
