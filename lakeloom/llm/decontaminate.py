"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the word positions of a window; the words picked are hashed, so a window still matches when the
other positions were replaced. Every window of every document is looked up in the test hashes, and each hit is verified by
an overlap of document and item around it: first on the hit's own diagonal, then by an alignment that also allows
insertions and deletions.

The test set is taken in blocks of at most ``BLOCK_CHARS`` characters (or one longer item), one after another: a block is sent to the
workers, all documents are read against it, what it finds is stored by row, and the block is freed. So a test set of any size works
with bounded memory, no document text is shuffled, and the result doesn't depend on how the test set is cut.

Places of one seed in a run of windows with that same seed count by the run's ends, as places between give no longer overlap.

Defined results: null or empty texts have no windows and are clean; an item of fewer than ``LEAST_WORDS`` words is never
matched; repeated documents are judged each, whatever their ids, and a repeated item counts once; other columns are not looked at;
an empty test set leaves all clean.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ROW, ROW_TYPE, by_bytes, cut, numbered, prepare_workers, task, temporary, texts_of, without
from lakeloom.llm.tokens import mix, words

#: Word positions that count, of a window; all of weight five.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 1, 4, 5, 7), (0, 2, 3, 6, 8))
LEAST_WORDS = 5
#: Matching words that make an overlap (or all of a shorter item), and the share of its words that must match.
OVERLAP_WORDS, IDENTITY = 13, 0.8
#: Characters of the test set in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Pairs of places held at once.
PAIRS = 1_000_000
#: Words that an aligned item may be shifted by insertions and deletions.
SLACK = 8
SCHEMA = "contaminated boolean, item_ids array<long>, matched_words long, identity double"


def _seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(hashes) - mask[-1]
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j, at in enumerate(mask):
            out += hashes[at : at + n] * np.uint64(2 * (j * 0x3C6EF372 + 0x1B873593) + 1)
        out += np.uint64(len(mask) * 0x9E3779B1 + mask[-1])
    return out


def _run_ends(seeds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which windows are the first or last of a run of equal seeds of one text."""
    out = np.ones(len(seeds), bool)
    if len(seeds) > 2:
        same = seeds[1:] == seeds[:-1]
        cuts = first[(first > 0) & (first < len(seeds))]
        same[cuts - 1] = False
        out[1:-1] = ~(same[1:] & same[:-1])
    return out


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of places whose counts (cumulated in ``ends``) make up at most ``most``, or single ones."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


class TestSet:
    """The hashed windows and the words of one block of test items."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words, self.first = words([t or "" for _, t in items])
        owner = np.repeat(np.arange(len(items)), np.diff(self.first))
        self.tables = []
        for mask in MASKS:
            seeds = _seeds(self.words, mask)
            at = np.arange(len(seeds))
            whole = owner[at] == owner[at + mask[-1]] if len(seeds) else np.zeros(0, bool)
            whole &= _run_ends(seeds, self.first)[: len(whole)] if len(seeds) else True
            seeds, at = mix(seeds[whole]), at[whole]
            order = np.argsort(seeds, kind="stable")
            bits = max(10, math.ceil(math.log2(8 * len(seeds) + 1)))
            filled = np.zeros(1 << bits, bool)
            filled[(seeds >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((seeds[order], at[order], filled, np.uint64(64 - bits)))
        self.owner = owner

    def hits(self, doc_words: np.ndarray, doc_first: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """Of each document with hits, the pairs (item, document position of the item's first word)."""
        kept = [np.zeros((0, 3), np.int64)]
        for mask, (seeds, at, filled, shift) in zip(MASKS, self.tables, strict=True):
            if not len(seeds):
                continue
            own = mix(_seeds(doc_words, mask))
            maybe = np.flatnonzero(filled[(own >> shift).astype(np.int64)])
            if not len(maybe):
                continue
            low, high = np.searchsorted(seeds, own[maybe]), np.searchsorted(seeds, own[maybe], side="right")
            docs = np.searchsorted(doc_first, maybe, side="right") - 1
            use = (high > low) & (maybe + mask[-1] < doc_first[docs + 1]) & _run_ends(own, doc_first)[maybe]
            maybe, low, high, docs = (x[use] for x in (maybe, low, high, docs))
            ends = np.cumsum(high - low)
            for a, b in _slices(ends, PAIRS):
                n = high[a:b] - low[a:b]
                own_ends = np.cumsum(n)
                q = at[np.arange(own_ends[-1]) - np.repeat(own_ends - n - low[a:b], n)]
                item, d = self.owner[q], np.repeat(docs[a:b], n)
                kept.append(np.unique(np.stack([d, item, np.repeat(maybe[a:b], n) - doc_first[d] - (q - self.first[item])], axis=1), axis=0))
        found: dict[int, set[tuple[int, int]]] = {}
        for d, item, place in np.unique(np.concatenate(kept), axis=0).tolist():
            found.setdefault(d, set()).add((item, place))
        return found

    def overlap(self, doc: np.ndarray, item: int, shift: int) -> tuple[int, float]:
        """(matching words, their share) of the best overlap near ``shift``, or (0, 0.0) if none is long enough."""
        test = self.words[self.first[item] : self.first[item + 1]]
        n, least = len(test), min(OVERLAP_WORDS, len(test))
        low, high = max(0, -shift), min(n, len(doc) - shift)
        same = test[low:high] == doc[low + shift : high + shift]
        best = (0, 0.0)
        if same.sum() >= least:
            # of the segments with IDENTITY or more the one with most matches
            gain = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - IDENTITY, -IDENTITY))])
            floor = np.minimum.accumulate(gain)
            counts = np.concatenate([[0], np.cumsum(same)])
            starts = np.searchsorted(-floor, -(gain + 1e-9))  # of each end the first place from where the gain isn't negative
            got = counts - counts[starts]
            end = int(got.argmax())
            best = (int(got[end]), float(got[end] / max(1, end - starts[end])))
            if best[0] < least:
                best = (0, 0.0)
        if best[0] < math.ceil(IDENTITY * n) and n >= LEAST_WORDS:
            window = doc[max(0, shift - SLACK) : max(0, shift + n + SLACK)]
            if np.isin(test, window).sum() < math.ceil(IDENTITY * n):
                return best
            row = np.zeros(len(window) + 1, np.int64)
            for w in test:
                step = row.copy()
                step[1:] = np.maximum(row[1:], row[:-1] + (window == w))
                row = np.maximum.accumulate(step)
            common = int(row[-1])
            if common >= math.ceil(IDENTITY * n) and common > best[0]:
                best = (common, common / n)
        return best


@task
def _judge(tests: TestSet, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.int64())), ("matched_words", pa.int64()), ("identity", pa.float64())])
    for batch in by_bytes(batches, "text"):
        doc_words, doc_first = words(texts_of(batch, "text"))
        hits = tests.hits(doc_words, doc_first)
        rows = []
        for d in range(batch.num_rows):
            found: dict[int, tuple[int, float]] = {}
            if d in hits:
                doc = doc_words[doc_first[d] : doc_first[d + 1]]
                for item, shift in hits[d]:
                    found[item] = max(found.get(item, (0, 0.0)), tests.overlap(doc, item, shift))
            kept = {i: x for i, x in found.items() if x[0] and len(tests.words[tests.first[i] : tests.first[i + 1]]) >= LEAST_WORDS}
            most = max(kept.values(), default=(0, 0.0))
            rows.append((bool(kept), sorted({tests.ids[i] for i in kept if tests.ids[i] is not None}), most[0], most[1]))
        found_ = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *found_], names=["doc_id", *types.names])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document: ``doc_id, contaminated, item_ids`` (ids of the items found, ascending), ``matched_words`` and
    ``identity`` of its longest overlap."""
    spark = docs.sparkSession
    prepare_workers(spark)
    kind = ROW_TYPE if id_col == ROW else "long"
    texts = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    blocks = _blocks(((r["i"], r["t"]) for r in items.toLocalIterator()), block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # nothing to bring together
        tests = spark.sparkContext.broadcast(TestSet(first))
        return texts.mapInArrow(lambda it: _judge(tests.value, it), f"doc_id {kind}, {SCHEMA}")
    with temporary(spark):
        texts = cut(texts.withColumn(ROW, F.monotonically_increasing_id()), "texts")  # a row has one number in all passes
        found = None
        for block in itertools.chain((first, second), blocks):
            tests = spark.sparkContext.broadcast(TestSet(block))
            part = texts.select(ROW, "text").mapInArrow(lambda it, tests=tests: _judge(tests.value, it), f"doc_id long, {SCHEMA}")
            part = cut(part.filter("contaminated").withColumnRenamed("doc_id", ROW), "found")
            tests.destroy()
            found = part if found is None else found.unionByName(part)
        merged = found.groupBy(ROW).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max(F.struct("matched_words", "identity")).alias("m"))
        none = F.array().cast("array<long>")
        out = texts.select(ROW, "doc_id").join(merged, ROW, "left")
        out = out.select("doc_id", F.col("m").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("m.matched_words", F.lit(0)).cast("long").alias("matched_words"), F.coalesce("m.identity", F.lit(0.0)).alias("identity"))
        return cut(out, "decontaminate", outer=True)


def _blocks(items: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Items in blocks of at most ``chars`` characters; one empty block if there is no item."""
    held, n, some = [], 0, False
    for item in items:
        if held and n + len(item[1] or "") > chars:
            yield held
            held, n, some = [], 0, True
        held.append(item)
        n += len(item[1] or "")
    if held or not some:
        yield held


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; all their columns stay."""
    docs = numbered(docs)
    return without(docs, cut(decontaminate(docs, benchmark, ROW, text_col).filter("contaminated").select(F.col("doc_id").alias(ROW)), "bad"))
