"""Best-fit packing of tokenised documents, certified by dual feasible functions.

A document longer than a sequence is cut into pieces, the first of which takes the remainder, so that all others fill a
sequence each. The remainders are dealt to partitions of about ``PART_ITEMS``; each packs its own by best-fit decreasing and
computes a lower bound of its number of bins from dual feasible functions. A partition whose bins equal the bound is
certified and done. Partitions with a gap give the documents of their worst-filled bins away, and of as many other bins drawn by a
hash: those are dealt anew into fewer partitions (a last open one repacks its own) and packed again by best-fit decreasing, and the
new packing is taken if it has fewer bins. This goes on while a round saves bins. The result says how many bins there are and
how many any packing needs at least.

Lengths are small integers, so best-fit decreasing runs over counts of lengths and of rooms left; its time doesn't depend
on the number of documents, and a partition has a bounded number of rows.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; null ids are kept; other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_bytes, cut, prepare_workers, task, texts_of
from lakeloom.llm.encode import encoder
from lakeloom.llm.tokens import mix

SEQUENCE, END_ID = 1024, 2
PART_ITEMS = 50_000
#: Bins given away by a partition with a gap: so many for each bin of the gap.
GIVE_BINS = 64


@task
def _pieces(path: str, kind: str, end_id: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end, enc = np.array([end_id], "<u4").tobytes(), encoder(path, kind)
    for batch in by_bytes(batches, "text"):
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(texts_of(batch, "text")), strict=True):
            raw = memoryview(ids + end)
            n = len(raw) // 4
            at = [0, *range(n % most or most, n, most), n] if n > most else [0, n]
            rows += [(doc_id, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def lower_bound(counts: np.ndarray, most: int) -> int:
    """Bins that items of these lengths need at least (``counts[l]`` items of length l): the best of the total length and of
    two families of dual feasible functions."""
    lengths = np.arange(len(counts))
    best = -(-int((counts * lengths).sum()) // most)
    used = lengths[counts > 0]
    for cut_at in sorted({int(x) for x in used if x <= most // 2} | {int(most - x) for x in used if x > most // 2}):
        # longer than most - cut_at: a whole bin; shorter than cut_at: nothing
        value = np.where(lengths > most - cut_at, most, np.where(lengths < cut_at, 0, lengths))
        best = max(best, -(-int((counts * value).sum()) // most))
    for k in range(1, 33):
        # u(k): a multiple of 1/(k+1) stays, others go down to a k-th
        scaled = (k + 1) * lengths
        value = np.where(scaled % most == 0, lengths * k, (scaled // most) * most)
        best = max(best, -(-int((counts * value).sum()) // (k * most)))
    return best


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing. Bins with equal room are taken last in, first out."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    made = i = 0
    while i < len(order):
        length = int(lengths[order[i]])
        j = i + int(np.searchsorted(-lengths[order[i:]], -length, side="right"))
        room = length
        while i < j:
            while room <= most and not rooms[room]:
                room += 1
            if room > most:
                own, room_left = made, most
                made += 1
            else:
                own, room_left = rooms[room].pop(), room
            # the same bin stays the best fit for the next item of this length as long as it has room
            fit = min(room_left // length, j - i) if length else j - i
            at = order[i : i + fit]
            bins[at] = own
            offsets[at] = most - room_left + length * np.arange(fit)
            i += fit
            left = room_left - fit * length
            rooms[left].append(own)
            room = min(room, max(left, length))
    return bins, offsets


def _packed(key: tuple, table: pa.Table, most: int, round_no: int) -> pa.Table:
    """The packing of a partition; ``given`` marks documents in bins that it gives away, ``saved`` the bins that this round
    saved (on the first none)."""
    lengths = table.column("length").to_numpy().astype(np.int64)
    order = np.lexsort((table.column("item").to_numpy(), lengths))[::-1]  # the same packing whatever the order of rows
    table, lengths = table.take(pa.array(order)), lengths[order]
    bins, offsets = best_fit(lengths, most)
    n, bound = int(bins.max()) + 1, lower_bound(np.bincount(lengths, minlength=most + 1), most)
    fill = np.bincount(bins, lengths, minlength=n)
    gap = n - bound
    give = np.zeros(n, bool)
    if gap:
        give[np.argsort(fill, kind="stable")[: min(n, GIVE_BINS * gap)]] = True
        drawn = mix(np.arange(n, dtype=np.uint64) + np.uint64((round_no + 1) * 0x9E3779B97F4A7C15 % 2**64))
        give[np.argsort(drawn, kind="stable")[: min(n, GIVE_BINS * gap)]] = True
    part = key[0].as_py()
    return pa.table({"item": table.column("item"), "length": table.column("length"), "part": pa.array(np.full(len(lengths), part)), "round": pa.array(np.full(len(lengths), round_no, np.int32)), "bin": bins, "offset": offsets, "given": give[bins], "bins": pa.array(np.full(len(lengths), n)), "bound": pa.array(np.full(len(lengths), bound))})


_PACKED = "item long, length long, part long, round int, bin long, offset long, given boolean, bins long, bound long"


def _pack_round(items: DataFrame, parts: int, most: int, round_no: int) -> DataFrame:
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(parts)).cast("long").alias("part"))
    return cut(dealt.groupBy("part").applyInArrow(lambda k, t: _packed(k, t, most, round_no), _PACKED), f"packed{round_no}")


def pack(items: DataFrame, most: int = SEQUENCE, part_items: int = PART_ITEMS) -> tuple[DataFrame, dict[str, int]]:
    """Pack ``items`` (item long, distinct; length 1 to ``most``). Returns (item, round, part, bin, offset) and the numbers
    ``bins``, ``bound`` (sum of the certificates of all partitions as first dealt, and of the whole) and ``rounds``."""
    n = items.count()
    if not n:
        empty = items.sparkSession.createDataFrame([], _PACKED)
        return empty.select("item", "round", "part", "bin", "offset"), {"bins": 0, "bound": 0, "rounds": 0}
    now = _pack_round(items, max(1, -(-n // part_items)), most, 0)
    done, total, rounds = [], 0, 1
    while True:
        count = lambda df: df.select("part", "bin").distinct().count()
        open_parts = now.filter("given").select("part").distinct().count()
        if not open_parts:
            done.append(now)
            total += count(now)
            break
        given, stay = now.filter("given").select("item", "length"), now.filter("not given")
        were = count(now.filter("given"))
        n = given.count()
        again = _pack_round(given, max(1, min(-(-n // part_items), open_parts // 2)), most, rounds)
        rounds += 1
        if count(again) >= were:
            done.append(now)
            total += count(now)
            break
        done.append(stay)
        total += count(stay)
        now = again
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lengths = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # most + 1 rows at most
    counts = np.zeros(most + 1, np.int64)
    for length, k in lengths.items():
        counts[length] = k
    return out.select("item", "round", "part", "bin", "offset"), {"bins": total, "bound": lower_bound(counts, most), "rounds": rounds}


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, most: int = SEQUENCE, part_items: int = PART_ITEMS) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and the number of all sequences, ``bins``, with
    a lower ``bound`` of it."""
    prepare_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = texts.mapInArrow(lambda it: _pieces(tokenizer, kind, end_id, most, it), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = cut(made.withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == most)
    packed, sums = pack(pieces.filter(F.col("length") < most).select("item", "length"), most, part_items)
    # sequences of whole pieces are numbered from 2**62 by item; others by round, partition and bin
    placed = pieces.filter(F.col("length") < most).join(packed, "item").withColumn("sequence_id", F.col("round").cast("long") * F.lit(2**56) + F.col("part") * F.lit(2**20) + F.col("bin"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = placed.select(*columns).unionByName(whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(2**62) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    full = whole.count()
    return out.withColumns({"bins": F.lit(sums["bins"] + full).cast("long"), "bound": F.lit(sums["bound"] + full).cast("long")})
