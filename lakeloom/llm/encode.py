"""Whole texts to ids as the tokenizers library gives them, encoding each distinct piece of many texts once.

Both vocabularies are applied piece by piece: no token reaches over the boundary of a piece, so the ids of a text are those
of its pieces in order. Texts with single blanks and line ends between their words are cut up together by array operations; words of
Latin letters get their ids from the vocabulary's merges, applied to all different words at once, and other pieces from the library.
The ids of frequent pieces that the library made come from a bounded table. The pieces are

* ``word``: what white space separates (white space itself has no ids);
* ``byte``: a run of other characters with the one blank before it, or white space that precedes no such blank.

A text that holds the string of one of the vocabulary's added tokens is encoded whole by the library, as its pieces don't show
where that token is cut out.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from lakeloom.llm.common import held
from lakeloom.llm.tokens import mix

#: Bytes of memory that a worker's table of pieces may take, unless the operator says otherwise; it holds those of the last half or more.
TABLE_BYTES = 80_000_000
#: What an entry takes besides its texts: two objects and a place in a dictionary.
_ENTRY = 180
#: The longest piece that is remembered, or made by array operations.
LONGEST = 64
#: Bytes of texts that are cut up together; longer texts are taken in parts that begin at blanks.
TOGETHER = 1_000_000
#: A piece that is one word of Latin letters with other marks after it: both vocabularies cut between the two.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,|!%&$#*?;:]*)")
_RUNS = re.compile(r"\s+(?!\S)| ?\S+|\s")
#: White space of which the library and Python have different ideas: a text with it is encoded whole.
_ODD = "\x1c\x1d\x1e\x1f\x85\u200b\ufeff"
#: A text without these has single blanks and line ends between its words; \0 marks a line's first word below.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: its own if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


_LETTERS = _byte_letters()


class _Table(dict):
    """The ids of pieces; what is missing is made, and kept unless it is long. A full table becomes the old one, from which pieces
    that come again are taken back, so its memory is bounded by ``most`` bytes and frequent pieces stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST:
            self.held += _ENTRY + len(piece) + len(ids)
            if 2 * self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


#: What a byte of UTF-8 is in texts cut up together: between words, a letter (with more of it), a mark that may follow, or another.
_BETWEEN, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0, 10, 32]] = _BETWEEN
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = _LETTER
_CLASS[list(b".,|!%&$#*?;:")] = _MARK
#: Lower case of the bytes of Latin letters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0x80, 0x9F)]] += 32
_powers: list[np.ndarray] = []


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of ``raw``, whose equality is checked by their bytes."""
    if not _powers or len(_powers[0]) < len(raw):
        up, down = np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64), np.full(len(raw), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up), np.cumprod(down)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * _powers[0][: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


class _Merges:
    """The merges of a byte-level vocabulary, applied to many words at once: in each round every word merges the first of its pairs of
    least rank, as the library does one by one."""

    #: No pair or symbol; words of one pass; bits of a place in the table of pairs.
    NONE, WORDS, BITS = 0xFFFF, 4096, 18

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in _LETTERS], np.uint16)
        self.last = np.array([vocab[c + suffix] for c in _LETTERS], np.uint16)
        self.made = np.array([vocab[a + b] for a, b in parts], np.uint16)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in parts], np.uint32)
        self.keys = np.full(1 << self.BITS, self.NONE << 16 | self.NONE, np.uint32)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.uint16)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):  # each to the first free place from its own on
            free = np.flatnonzero(self.ranks[at] == self.NONE)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.ranks[at[free]] = keys[left[free]], left[free]
            stay = np.ones(len(left), bool)
            stay[free] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.BITS) - 1)

    @classmethod
    def of(cls, path: str) -> _Merges | None:
        """None if the vocabulary has anything but plain merges of single bytes, each of which makes another token."""
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or max(model["vocab"].values()) >= cls.NONE or not 0 < len(model["merges"]) < cls.NONE:
            return None
        suffix = model.get("end_of_word_suffix") or ""
        if not all(c in model["vocab"] and c + suffix in model["vocab"] for c in _LETTERS):
            return None
        merges = cls(model)
        return merges if len(np.unique(merges.made)) == len(merges.made) else None

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)).astype(np.intp)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint32) << np.uint32(16)) | b
        at = self._place(keys)
        other = self.keys[at] != keys
        out = self.ranks[at]
        left = np.flatnonzero(other & (out != self.NONE))
        out[other] = self.NONE
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.BITS) - 1)
            found = self.ranks[at]
            same = self.keys[at] == keys[left]
            out[left[same]] = found[same]
            on = ~same & (found != self.NONE)
            left, at = left[on], at[on]
        return out

    def ids(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of ``raw``, one word after the other in the order of ``sizes`` (rising), and the number of each word's."""
        parts = [self._pass(raw, starts[k : k + self.WORDS], sizes[k : k + self.WORDS]) for k in range(0, len(starts), self.WORDS)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def _pass(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(starts), int(sizes[-1]) + 2  # a column without a symbol at either side
        rows = np.arange(n)
        letters = raw[np.minimum(starts[:, None] + np.arange(wide - 2), len(raw) - 1)]
        table = np.full((n, wide), self.NONE, np.uint16)
        table[:, 1:-1] = self.inner[letters]
        table[rows, sizes] = self.last[letters[rows, sizes - 1]]
        table[np.arange(wide) > sizes[:, None]] = self.NONE
        symbols = table.ravel()
        there = symbols != self.NONE
        after = np.arange(1, n * wide + 1)
        before = after - 2
        ranks = np.full(n * wide, self.NONE, np.uint16)
        at = np.flatnonzero(there)
        ranks[at] = self._rank(symbols[at], symbols[at + 1])
        by_word = ranks.reshape(n, wide)
        while True:
            at = by_word[rows].argmin(1) + rows * wide
            rank = ranks[at]
            more = rank != self.NONE
            rows, at, rank = rows[more], at[more], rank[more]
            if not len(rows):
                return symbols[there], there.reshape(n, wide).sum(1)
            gone, left = after[at], before[at]
            right = after[gone]
            symbols[at] = new = self.made[rank]
            there[gone] = False
            ranks[gone] = self.NONE
            after[at], before[right] = right, at
            ranks[at], ranks[left] = self._rank(new, symbols[right]), self._rank(symbols[left], new)


class Encoder:
    """``batch(texts)``: their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str, table_bytes: int = TABLE_BYTES):
        if kind not in ("word", "byte"):
            raise ValueError(f"kind is {kind!r}; it must be 'word' or 'byte'")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        #: Added tokens, as the vocabulary's normaliser may write them.
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.signs = sorted({t[0] for t in self.added})
        self.model = self.tokenizer.model
        self.merges = _Merges.of(path)
        # pieces of texts that are cut up together, and of others
        self.known = _Table(self._piece, table_bytes)
        self.plain = _Table(self._piece, table_bytes // 16)
        self.marks = _Table(self._core, table_bytes // 16)

    def width(self) -> int:
        """Bytes that hold any id of the vocabulary: 2 or 4."""
        return 2 if max(self.tokenizer.get_vocab_size(), *(i + 1 for i in self.tokenizer.get_added_tokens_decoder()), 0) <= 1 << 16 else 4

    def whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _has_added(self, text: str) -> bool:
        if not any(s in text for s in self.signs):
            return False
        lower = text.lower()
        return any(t in lower for t in self.added)

    def _core(self, word: str) -> bytes:
        """The ids of a run of letters or of marks, which the library's model takes as one word."""
        spelled = word if word.isascii() and " " not in word else "".join([_LETTERS[b] for b in word.encode()])
        return _little([t.id for t in self.model.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return _little([t.id for t in self.model.tokenize(piece.lower() if self.kind == "word" else piece)])
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.whole(piece)
        blank, word, marks = plain.groups()
        first = self._core(word.lower() if self.kind == "word" else blank + word)
        return first + self.marks[marks] if marks else first

    def _units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin, of which \0 and a line end or blank start each word, and whether a piece has letters alone
        (with the blank before it, if that is part of it)."""
        kinds = _CLASS[raw]
        odd = np.flatnonzero(((raw[1:] & 0xC0) == 0x80) & (raw[:-1] != 0xC3)) + 1
        kinds[odd] = _OTHER
        between = kinds == _BETWEEN
        words, owner = np.flatnonzero(between), np.cumsum(between) - 1
        now, last = kinds[1:], kinds[:-1]
        strange = kinds == _OTHER
        strange[1:] |= ((now == _LETTER) & (last == _MARK)) | ((now == _MARK) & (last == _BETWEEN))
        strange = np.logical_or.reduceat(strange, words)
        begins = between
        alone = words if self.kind == "word" else words[raw[words] != 32]
        begins[alone[alone + 1 < len(raw)] + 1] = True
        marks = np.flatnonzero((now == _MARK) & (last == _LETTER)) + 1
        begins[marks[~strange[owner[marks]]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        return starts, ~strange[owner[starts]] & (kinds[ends - 1] == _LETTER) & (ends - starts <= LONGEST)

    def _together(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part of a text: \0 and its beginning, or a later part from a blank on."""
        joined = b"".join(parts)
        raw = np.frombuffer(joined, np.uint8)
        starts, letters = self._units(raw)
        ends = np.append(starts[1:], len(raw))
        sizes = ends - starts
        _, first, which = np.unique(_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        same = first[which]
        if (sizes[same] != sizes).any() or (raw[np.repeat(starts[same] - starts, sizes) + np.arange(len(raw))] != raw).any():
            first = which = np.arange(len(starts))  # two pieces of one hash: each is made by itself
        counts, begin, pool, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), [], 0
        plain = letters[first] if self.merges else np.zeros(len(first), bool)
        some = np.flatnonzero(plain)
        if len(some):
            some = some[np.argsort(sizes[first[some]], kind="stable")]
            at = first[some]
            ids, counts[some] = self.merges.ids(_LOWER[raw] if self.kind == "word" else raw, starts[at], sizes[at])
            begin[some] = np.cumsum(counts[some]) - counts[some]
            pool.append(ids.astype("<u4"))
            n = len(ids)
        none = (b"\0", b" ", b"\n") if self.kind == "word" else (b"\0",)
        for i in np.flatnonzero(~plain).tolist():
            piece = joined[starts[first[i]] : ends[first[i]]]
            if piece not in none:
                ids = np.frombuffer(self.known[piece.decode()], "<u4")
                counts[i], begin[i] = len(ids), n
                pool.append(ids)
                n += len(ids)
        each = counts[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = (np.concatenate(pool)[np.repeat(begin[which] - upto[:-1], each) + np.arange(upto[-1])] if pool else np.zeros(0, "<u4")).tobytes()
        bounds = 4 * upto[np.searchsorted(starts, np.cumsum([0, *map(len, parts)]))]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _one_by_one(self, text: str) -> bytes:
        if self.kind == "word":
            return b"".join(map(self.known.__getitem__, text.split()))
        return b"".join([self.plain[p] for p in _RUNS.findall(text)])

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, wait, n = [b""] * len(texts), [], 0

        def end() -> None:
            for (i, _), ids in zip(wait, self._together([part for _, part in wait]) if wait else [], strict=True):
                out[i] += ids
            wait.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            plain = t.isascii()
            if any(x in t for x in (_ODD[:4] if plain else _ODD)) or self._has_added(t):
                out[i] = self.whole(t)
            elif t != t.strip() or any(x in t for x in (_UNEVEN[:9] if plain else _UNEVEN)):
                out[i] = self._one_by_one(t)
            else:
                raw, at = b"\0" + t.encode(), 0
                while at < len(raw):
                    to = len(raw) if len(raw) - at <= TOGETHER else max(raw.rfind(b" ", at + 1, at + TOGETHER), 0) or raw.find(b" ", at + TOGETHER)
                    to = to if to > 0 else len(raw)
                    if n + to - at > TOGETHER:
                        end()
                        n = 0
                    if to - at > TOGETHER:  # a word longer than that
                        out[i] += self._one_by_one(raw[at:to].lstrip(b"\0").decode())
                    else:
                        wait.append((i, raw[at:to]))
                        n += to - at
                    at = to
        end()
        return out


def encoder(path: str, kind: str, table_bytes: int = TABLE_BYTES) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    return held((path, kind, table_bytes), lambda: Encoder(path, kind, table_bytes))
