"""Token ids of whole texts by a public tokenizer, as unsigned 32-bit integers.

White space ends every token of the vocabularies used here: a text may be cut before any
run of white space without a change to its ids, as neither normalisation nor the splitting
pattern looks across such a place; nor does the pattern between a Latin letter and a sign
after it, or a line end by itself and a letter.  So texts are cut into words with the space
before them and runs of signs, each distinct piece of a column is encoded by the tokenizers library once, and its ids are dealt
to all its places.  A worker remembers the ids of recent pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

#: A word of Latin letters, perhaps after one space, or signs without an apostrophe: one token
#: group, whatever the vocabulary's splitting pattern.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+").fullmatch
#: Slots of what a worker remembers, unless told otherwise, and ids per slot at which it starts afresh.
SLOTS, _POOL = 1 << 20, 4

#: Kinds of bytes: white space, and that which isn't a space; letters; signs before which a word may be cut off
#: (``|`` ends the names of special tokens).
_KIND = np.zeros(256, np.uint8)
_SPACE, _BREAK, _LETTER, _SIGN = 1, 2, 4, 8
_KIND[[9, 10, 11, 12, 13]] = _SPACE | _BREAK
_KIND[32] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|"]] = _SIGN
#: Second bytes of the letters from U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: Last bytes of white space beyond ASCII in UTF-8 (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_LAST = np.zeros(256, bool)
_LAST[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


def cut_at_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, one after the other, and how many each text has.

    A text is cut before ASCII white space that follows anything but white space, of ASCII or
    not, between a single line end and a letter, and between a Latin letter and a sign.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, last = int(ends[0]), int(ends[-1])
    if first == last:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(data, np.uint8, last - first, first)
    kind = _KIND[raw]
    starts = (kind & _SPACE).view(bool)
    starts[1:] &= (kind[:-1] & _SPACE) == 0
    at = np.flatnonzero(starts)
    odd = at[_LAST[raw[at - 1]] & (at > 0)]
    if len(odd):  # the last byte could end white space beyond ASCII
        two, three = raw[np.maximum(odd - 2, 0)], raw[np.maximum(odd - 3, 0)]
        end = raw[odd - 1]
        wide = ((two == 0xC2) & ((end == 0x85) | (end == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (end == 0x80)) | ((three == 0xE3) & (two == 0x80) & (end == 0x80))
        wide |= (three == 0xE2) & (((two == 0x80) & (end != 0xA0) & (end != 0x9F)) | ((two == 0x81) & (end == 0x9F)))
        starts[odd[wide]] = False
    # a line end by itself is a token of its own before a letter
    breaks = np.flatnonzero(kind[:-1] & _BREAK)
    breaks = breaks[starts[breaks] & ((kind[breaks + 1] & _LETTER) != 0)]
    signs = np.flatnonzero(kind & _SIGN)
    signs = signs[((kind[signs - 1] & _LETTER) != 0) | (_LATIN[raw[signs - 1]] & (raw[signs - 2] == 0xC3))]
    starts[breaks + 1] = starts[signs] = True
    own = ends[:-1][ends[1:] > ends[:-1]] - first
    starts[own] = True
    cuts = np.append(np.flatnonzero(starts), len(raw)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data.slice(first, last - first))
    return pieces, np.diff(np.searchsorted(cuts, ends - first))


def dealt(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)]


class Encoder:
    """Maps columns of texts to ids, by what it remembers of pieces in ``slots`` (a power of two)."""

    def __init__(self, path: str, slots: int = SLOTS) -> None:
        from tokenizers import Tokenizer

        self._slots = slots
        self._tokenizer = Tokenizer.from_file(path)
        self._model, split = self._tokenizer.model, self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._folds = self._tokenizer.normalizer is not None and self._tokenizer.normalizer.normalize_str("A") == "a"
        # how the vocabulary's alphabet spells a character, asked of the splitter once
        self._spelling = {ord(c): "".join(g for g, _ in split(c)) for c in map(chr, (*range(33, 127), *range(0xC0, 0x100)))}
        self._spelling[32] = split(" a")[0][0].removesuffix("a")
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros((self._slots, 2), np.uint64)
        self._at, self._size = np.zeros(self._slots, np.int32), np.zeros(self._slots, np.int32)
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def make(self, piece: str) -> list[int]:
        """Ids of a piece; those of one token group by the vocabulary's merges alone."""
        if _PLAIN(piece):
            if self._folds:
                piece = piece.lower().lstrip()
            return [t.id for t in self._model.tokenize(piece.translate(self._spelling))]
        return self._tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids

    def make_all(self, pieces: list[str]) -> Iterator[list[int]]:
        """Ids of pieces, as :meth:`make` has them; plain ones are spelled together, since none holds a line end."""
        if self._folds:
            yield from map(self.make, pieces)
            return
        plain = [_PLAIN(p) is not None for p in pieces]
        spelled = iter("\n".join(compress(pieces, plain)).translate(self._spelling).split("\n"))
        tokenize = self._model.tokenize
        for piece, is_plain in zip(pieces, plain, strict=True):
            yield [t.id for t in tokenize(next(spelled))] if is_plain else self.make(piece)

    def _find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids start, and how many there are."""
        if self._used > _POOL * self._slots:
            self._forget()
        keys = np.frombuffer(b"".join(map(xxh3_128_digest, pieces)), "<u8").reshape(-1, 2)
        slots = (keys[:, 0] & np.uint64(self._slots - 1)).astype(np.int64)
        known = (self._keys[slots] == keys).all(1)
        at, size = self._at[slots].astype(np.int64), self._size[slots].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            made: list[int] = []
            ends = []
            fresh = [pieces[k] for k in new.tolist()]
            for ids in self.make_all(fresh):
                made += ids
                ends.append(len(made))
            size[new] = np.diff(np.array([0, *ends]))
            at[new] = self._used + np.array(ends) - size[new]
            grown = self._used + len(made)
            if grown > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros(grown, np.uint32)])
            self._pool[self._used : grown] = made
            self._used = grown
            self._keys[slots[new]], self._at[slots[new]], self._size[slots[new]] = keys[new], at[new], size[new]
        return at, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each with ``end_id`` after it, and where each text's start (and the last one's end).

        Null counts as empty, which has the end id only.
        """
        pieces, counts = cut_at_spaces(texts)
        found = pieces.dictionary_encode()
        at, size = self._find(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = found.indices.to_numpy()
        sizes = size[codes]
        through = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.insert(dealt(self._pool, at[codes], sizes), through[np.cumsum(counts)], end_id)
        return ids, np.concatenate(([0], through[np.cumsum(counts)] + np.arange(1, len(texts) + 1)))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, slots: int = SLOTS) -> Encoder:
    """This worker's encoder for a vocabulary file; one for another file, or with other slots, is forgotten."""
    if (path, slots) not in _encoders:
        _encoders.clear()
        _encoders[path, slots] = Encoder(path, slots)
    return _encoders[path, slots]


def forget_encoder() -> None:
    """Free this worker's encoder, before a step of another kind takes memory of its own."""
    _encoders.clear()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
