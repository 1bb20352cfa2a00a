"""Whole-text encoding with the tokenizers library, remembering the pieces of texts.

The pre-tokens of the two kinds of vocabularies used here never reach over certain places: before a space or line end
that no white space follows, or between a letter and a mark behind it.  So the ids of a text are the ids of its pieces
between such places, one after the other.  A batch's bytes are cut there at once, its distinct pieces are looked up, and
only those not known yet go to the library.  Texts that may hold the string of a special token go to it whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from docweave.llm.common import on_release, release_caches, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _these(*ranges: bytes | range | tuple[int, ...]) -> np.ndarray:
    mask = np.zeros(256, bool)
    for r in ranges:
        mask[[*r]] = True
    return mask


_GAP = _these(b" \n")
#: Bytes that are white space or may begin it.
_MAYBE_SPACE = _these(range(0x09, 0x0E), range(0x1C, 0x21), (0xC2, 0xE1, 0xE2, 0xE3))
_LETTER = _these(range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1))
_MARK = _these(b".,!?#$%&*|;:")
#: White space as a space, A-Z in lower case.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x09:0x0E] = 0x20
_PLAIN[ord("A") : ord("Z") + 1] += 32

_LETTERS = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
#: How byte-level vocabularies show the 256 bytes: printable ones as they are, others from U+0100 on.
_SHOWN = {b: b for b in _LETTERS} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_LETTERS}))}


class PieceEncoder:
    """Ids of texts, of two or four bytes each (``dtype``).

    ``keeps_space`` tells a byte-level vocabulary, where a space belongs to the piece behind it, from one whose
    pre-tokens leave white space out and whose letters are lower case.  Past ``limit`` pieces those stay that two batches
    held, at most half of the limit, which are the ones that most batches held.  That bounds memory and never changes ids.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer(self.tokenizer.model)  # the model alone, for pieces that are one pre-token
        self.keeps_space = keeps_space
        self.limit = limit
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 14, np.int64)  # of each piece's ids; one more than pieces
        self.held = np.zeros(1 << 14, np.uint8)  # batches that held it

    def _ids(self, tokenizer: Tokenizer, texts: Sequence[str]) -> list[bytes]:
        code, out = "H" if self.dtype.itemsize == 2 else "I", []
        for i in range(0, len(texts), 2000):  # what the library makes of a text is much larger than its ids
            out += [array(code, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
        return out

    def _single(self, piece: bytes) -> str | None:
        """A piece of letters alone as the model reads it, which spares normal forms and pre-tokens; else None."""
        if self.keeps_space:
            spaced, letters = piece[:1] == b" ", piece.removeprefix(b" ")
            if letters.isalpha():  # ASCII alone
                return ("\u0120" if spaced else "") + letters.decode()
            return piece.decode("latin-1").translate(_SHOWN) if letters.decode().isalpha() else None
        letters = piece.rstrip(b" ")
        if letters.isalpha():
            return letters.decode()
        text = letters.decode()
        if not text.isalpha() or max(text) >= "\u0130":  # other letters may have longer lower cases and normal forms
            return None
        return text.lower().encode().decode("latin-1").translate(_SHOWN)

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        shown = [*map(self._single, pieces)]
        found = iter(self._ids(self.bare, [s for s in shown if s is not None]))
        rest = iter(self._ids(self.tokenizer, [p.decode() for p, s in zip(pieces, shown) if s is None]))
        return [next(rest) if s is None else next(found) for s in shown]

    def _learn(self, new: list[bytes]) -> None:
        found = self._encoded(new)
        count = len(self.known)
        sizes = np.cumsum([len(x) // self.dtype.itemsize for x in found]) + self.starts[count]
        if sizes[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), sizes[-1]), self.dtype)])
        if count + len(new) + 1 > len(self.starts):
            more = max(len(self.starts), len(new) + 1)
            self.starts, self.held = np.concatenate([self.starts, np.zeros(more, np.int64)]), np.concatenate([self.held, np.zeros(more, np.uint8)])
        self.ids[self.starts[count] : sizes[-1]] = np.frombuffer(b"".join(found), self.dtype)
        self.starts[count + 1 : count + 1 + len(new)] = sizes
        self.known.update(zip(new, range(count, count + len(new))))

    def _forget(self) -> None:
        """Keeps the pieces that most batches held, two at least, once there are more than the limit; counts are halved."""
        if len(self.known) <= self.limit:
            return
        known, ids, starts, held = list(self.known), self.ids, self.starts, self.held
        keep = np.flatnonzero(held[: len(known)] > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(held[keep], kind="stable")[-(self.limit // 2) :]]) if self.limit > 1 else keep[:0]
        self._empty()
        sizes = starts[keep + 1] - starts[keep]
        self.starts = np.concatenate([[0], np.cumsum(sizes), np.zeros(len(keep) + 1024, np.int64)])
        self.held = np.zeros(len(self.starts), np.uint8)
        self.held[: len(keep)] = held[keep] // 2
        self.ids = ids[spread(starts[keep], sizes)]
        self.known = {known[k]: i for i, k in enumerate(keep.tolist())}

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, where pieces start (and the end), and how many pieces stand before each text and in all."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            if self.keeps_space:
                cut[1:-2] = _GAP[data[1:-1]] & ~_MAYBE_SPACE[data[2:]]
                cut[at - 1] = False  # nothing follows a text's last byte
            else:
                data = _PLAIN[data]
                space = data == 0x20
                cut[1:-1] = space[:-1] & ~space[1:]
            cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[at] = True
        edges = np.flatnonzero(cut)
        return data, edges, np.searchsorted(edges, at)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch's texts, one text behind the other, and where each text's start; a null text is empty."""
        text = pc.fill_null(text, "")
        odd = np.flatnonzero(pc.match_substring(text, "<|").to_numpy(zero_copy_only=False))
        if len(odd):
            return self._with_odd(text, odd)
        data, edges, before = self._pieces(*text_bytes(text))
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(text) + 1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([distinct[i] for i in new.tolist()])
        self.held[place] = np.minimum(self.held[place], 254) + 1
        place = place[pieces.indices.to_numpy()]
        sizes = self.starts[place + 1] - self.starts[place]
        ids = self.ids[spread(self.starts[place], sizes)]
        self._forget()
        return ids, np.concatenate([[0], np.cumsum(sizes)])[before]

    def _with_odd(self, text: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may hold a special token's string are encoded whole."""
        whole = dict(zip(odd.tolist(), self._ids(self.tokenizer, [text[i].as_py() for i in odd.tolist()])))
        mask = np.ones(len(text), bool)
        mask[odd] = False
        ids, at = self.encode(text.filter(pa.array(mask)))
        parts, j = [], 0
        for i in range(len(text)):
            if i in whole:
                parts.append(np.frombuffer(whole[i], self.dtype))
            else:
                parts.append(ids[at[j] : at[j + 1]])
                j += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... sizes[i] of them, for each i."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


_encoders: dict[tuple, PieceEncoder] = {}
on_release.append(_encoders.clear)


def encoder(path: str, keeps_space: bool, limit: int = 600_000) -> PieceEncoder:
    """The encoder of this Python worker for a vocabulary file, kept from task to task; a new one empties other caches."""
    if (key := (path, keeps_space, limit)) not in _encoders:
        release_caches()
        _encoders[key] = PieceEncoder(path, keeps_space, limit)
    return _encoders[key]
