"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie with two roots (a word's first piece, its later pieces). A node where no longer match can follow
has a failure link to the node from which matching goes on, and the number of pieces popped on the way, both computed once.
Counting follows one link a character, amortised, and never builds a piece.

The vocabulary is read from a tokenizer file; every entry, without its end-of-word mark, may be a first and a later piece.
Such a vocabulary marks no later pieces, so this stands in for one that does.
Words are what white space separates in the lower-cased text, with each punctuation mark a word of its own. A word that the
pieces don't cover counts as one unknown token, whatever its length.

Defined results: null and empty texts have no words; repeated rows are counted each; other columns are not looked at.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_bytes, held, prepare_workers, task, texts_of
from lakeloom.llm.encode import _LETTERS

#: Distinct words remembered by a worker, and the longest of them.
MOST_WORDS, LONGEST = 400_000, 64
_FIELD = 1 << 40


def pieces(path: str) -> set[str]:
    """The vocabulary of a byte-level tokenizer file as plain texts; entries that aren't whole characters are left out."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(_LETTERS)}
    out = set()
    for entry in vocab:
        try:
            text = bytes(byte[c] for c in entry.removesuffix("</w>")).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not any(c.isspace() for c in text):
            out.add(text)
    return out


class Automaton:
    """Counts the pieces of a word. ``first`` and ``later``: the pieces that may start a word and that may follow."""

    def __init__(self, first: Iterable[str], later: Iterable[str] | None = None):
        first = set(first)
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, words in ((0, first), (1, first if later is None else set(later))):
            for w in words:
                at = root
                for c in w:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        level = [(0, c, v) for c, v in self.next[0].items()] + [(1, c, v) for c, v in self.next[1].items()]
        while level:
            deeper = []
            for parent, c, v in level:
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    at, pops = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        pops += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.popped[v] = self.next[at][c], pops
                deeper += [(v, k, x) for k, x in self.next[v].items()]
            level = deeper

    def count(self, word: str) -> int | None:
        """The number of pieces of ``word``; None where they don't cover it."""
        at = n = 0
        for c in word:
            while True:
                to = self.next[at].get(c)
                if to is not None:
                    at = to
                    break
                n += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return None
        while at != 1:
            n += self.popped[at]
            at = self.fail[at]
            if at < 0:
                return None
        return n


def _is_mark(c: str) -> bool:
    return (c.isascii() and c.isprintable() and not c.isalnum() and c != " ") or unicodedata.category(c).startswith("P")


def split_words(chunk: str) -> list[str]:
    """A run without white space as words: marks stand alone."""
    if chunk.isalnum():
        return [chunk]
    out, held = [], ""
    for c in chunk:
        if _is_mark(c):
            out += [held, c] if held else [c]
            held = ""
        else:
            held += c
    return [*out, held] if held else out


class _Counts(dict):
    """words, pieces and unknown words of a run of characters, in fields of one number."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, chunk: str) -> int:
        total = 0
        for w in split_words(chunk):
            n = self.automaton.count(w)
            total += 1 + (_FIELD * n if n is not None else _FIELD + _FIELD * _FIELD)
        if len(chunk) <= LONGEST:
            self[chunk] = total
        return total


@task
def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = held(("pieces", path), lambda: _Counts(Automaton(pieces(path))))
    for batch in by_bytes(batches, "text"):
        if len(known) > MOST_WORDS:
            known.clear()
        totals = [sum(map(known.__getitem__, t.lower().split())) for t in texts_of(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([t // _FIELD**k % _FIELD for t in totals], pa.int64()) for k in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id, n_words, n_tokens, n_unknown``."""
    prepare_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _counted(tokenizer, it), "doc_id long, n_words long, n_tokens long, n_unknown long")
