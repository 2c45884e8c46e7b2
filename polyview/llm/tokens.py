"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once per worker.

Both vocabularies cut a text at white space before they merge anything, so a text's ids are those of its
pieces in order. Where the vocabulary drops white space, the pieces are the words. Where it keeps it, a piece is a word
with the space before it, a word without one (after a line break, and at the start), a space or a line break: so a run
of white space is cut by the library too, unless it has three characters and more or ends the text with two. A worker process
remembers the pieces' ids, within a bound. Texts with such runs, with other white space or control
characters than spaces and line breaks, or with the string of a special token, go to the library whole.

Strings of special tokens in a text get the special ids, as the library does it; ``plain`` takes them as ordinary text.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

from polyview.llm.common import KEPT, Memo

#: Characters that regular expressions may count as white space or that normalisation may drop; surrogates can't be encoded.
_ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿\ud800-\udfff]")
#: Bytes of UTF-8 that none of them has, or that have to be looked at.
_EVEN = bytes(b for b in range(256) if b == 0x0A or 0x20 <= b < 0x7F or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xEC or b == 0xEE or b >= 0xF0)
_RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
_ENDS = ("  ", " \n", "\n ", "\n\n")
#: Marks a piece without a space before it; no even text has it.
_BARE = "\x01"

#: Letters that stay one piece and as they are, but for their case, in both vocabularies; behind them marks, whose run is a piece of its
#: own (an apostrophe may go with letters). The most frequent runs are known from the start.
_PLAIN = re.compile(f"(({_BARE}?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+))([!-&(-/:-@\\[-`{{-~]*)")
_MARKS = ".,;:!?"


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a letter: visible characters of Latin-1 stand for themselves, the other bytes for
    the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_BYTE = "".join(_byte_letters())
_SPACE = _BYTE[0x20]


def is_odd(text: str) -> bool:
    if text.isascii():
        return bool(text.encode().translate(None, _EVEN))
    try:
        return bool(text.encode().translate(None, _EVEN)) and _ODD.search(text) is not None
    except UnicodeEncodeError:
        return True


class Pieces(dict):
    """Ids of pieces. A plain piece that is lacking is merged when it is asked for; another one is None and put down as odd."""

    def __init__(self, plain: Callable[[str], bytes | None], older: dict[str, bytes], odd: dict[str, None]):
        super().__init__()
        self.plain, self.older, self.odd = plain, older, odd

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.plain(piece)
            if ids is None:
                self.odd[piece] = None
                return None
        self[piece] = ids
        return ids


class Encoder:
    """keeps_spaces: whether the vocabulary has tokens for white space (byte-level) or drops it."""

    def __init__(self, path: str, keeps_spaces: bool, dtype: str = "<u4", limit: int = 400_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.model._resize_cache(0)  # what is met again is in ``known``
        self.specials = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_spaces, self.dtype, self.limit = keeps_spaces, np.dtype(dtype), limit
        raw, size = np.arange(max(self.tokenizer.get_vocab().values()) + 1).astype(self.dtype).tobytes(), self.dtype.itemsize
        self.raw = [raw[at : at + size] for at in range(0, len(raw), size)]
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = Memo(self._merged)
        for m in _MARKS:
            self.marks[m]
        self.known = Pieces(self._plain, {}, {})  # pieces move on from ``older`` when they are met again

    def pieces(self, text: str) -> list[str] | None:
        """None for a text that has to be encoded whole."""
        if any(s in text for s in self.specials) or is_odd(text):
            return None
        if not self.keeps_spaces:
            return text.split()
        if "\n" in text:
            if any(r in text for r in _RUNS):
                return None
            spaced = (_BARE + text).replace("\n", f" \n {_BARE}")
        else:
            if "   " in text:
                return None
            spaced = _BARE + text
        return None if text.endswith(_ENDS) else spaced.split(" ")

    def whole(self, text: str) -> bytes:
        text = text.encode("utf-8", "replace").decode()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers; none for a null."""
        if len(self.known) > self.limit:
            self.known.older = {}
            self.known = Pieces(self._plain, self.known, {})
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[str], list[bytes | None]]] = []
        self.tokenize = self.tokenizer.model.tokenize
        get, first, copies = self.known.__getitem__, {}, []
        for n, t in enumerate(texts):
            if first.setdefault(t, n) != n:
                copies.append((n, first[t]))
                out.append(None)
                continue
            own = self.pieces(t) if t else []
            if own is None:
                out.append(self.whole(t))
                continue
            ids = list(map(get, own))
            if None in ids:
                waiting.append((len(out), own, ids))
                out.append(None)
            else:
                out.append(b"".join(ids))
        if waiting:
            self._learn(list(self.known.odd))
            self.known.odd.clear()
            for n, own, ids in waiting:
                out[n] = b"".join([get(p) if x is None else x for p, x in zip(own, ids, strict=True)])
        for n, k in copies:
            out[n] = out[k]
        return out

    def _merged(self, word: str) -> bytes:
        raw = self.raw
        return b"".join([raw[x.id] for x in self.tokenize(word)])

    def _plain(self, piece: str) -> bytes | None:
        """Plain words, perhaps with marks behind them, are merged by the library's model at once; its whole chain of
        normalisation and cutting, which leaves them as they are, costs as much again. A word that is known, or comes with
        other marks, is merged once. None for all else."""
        if piece.isascii() and piece.isalpha():
            return self._merged(_SPACE + piece if self.keeps_spaces else piece.lower())
        m = _PLAIN.fullmatch(piece)
        if m is None:
            return None
        stem, bare, word, marks = m.groups()
        if marks:
            return self.known[stem] + self.marks[marks]
        if not self.keeps_spaces:
            word = word.lower()
        if not word.isascii():
            word = codecs.charmap_decode(word.encode(), "strict", _BYTE)[0]
        return self._merged(word if bare or not self.keeps_spaces else _SPACE + word)

    def _learn(self, pieces: list[str]) -> None:
        """The library's way for pieces that aren't plain."""
        for at in range(0, len(pieces), 50_000):
            part = pieces[at : at + 50_000]
            texts = part if not self.keeps_spaces else [p if p == "\n" else p[1:] if p.startswith(_BARE) else f" {p}" for p in part]
            one = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(one.word_ids, np.int64), np.arange(len(part) + 1)) * self.dtype.itemsize
            raw, ends = np.array(one.ids, self.dtype).tobytes(), ends.tolist()
            self.known.update((p, raw[a:b]) for p, a, b in zip(part, ends[:-1], ends[1:], strict=True))

    def by_step(self, texts: list[str | None], chars: int = 4_000_000) -> Iterable[list[bytes]]:
        """encode() over stretches of about so many characters, which bounds what a step holds."""
        at, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= chars or k == len(texts) - 1:
                yield self.encode(texts[at : k + 1])
                at, size = k + 1, 0

    def in_steps(self, texts: list[str | None], chars: int = 4_000_000) -> Iterable[bytes]:
        """The same, one text at a time."""
        for step in self.by_step(texts, chars):
            yield from step


@functools.lru_cache(maxsize=4)
def encoder(path: str, keeps_spaces: bool, dtype: str = "<u4", plain: bool = False) -> Encoder:
    """One for each worker process, so what it remembers outlasts a task."""
    return Encoder(path, keeps_spaces, dtype, plain=plain)


KEPT.append(encoder.cache_clear)
