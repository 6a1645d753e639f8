"""Token-id shards with a minimal perfect hash index over raw id payloads.

File format. A shard is one file of an output folder (``kind=shard/part=P/block=B``): all ids (little-endian, without separators, uint16 if
the vocabulary and the end id fit, else uint32), then its index, a footer of FOOTER bytes and one line end. The index has, in this order, ``levels`` (int32 sizes),
``ranks`` (int64: set bits before each BLOCK_BITS bits), ``bits`` (one bit a position, all levels, padded to whole blocks), ``slots``
(two int64: offset of the first id, number of ids), ``prints`` (uint16 fingerprints), both in hash order, ``keys`` (int64) and
``repeats`` (int32: the how-manieth document of this key in the shard), both in file order. The footer has the magic and part, block,
ids, documents, levels, bits and bytes of an id. ``manifest`` (Parquet, a row per shard) has the range of keys of each.

A key is hashed on the first level; if other keys of the shard share its position it goes on to the next level, and so on.
The position of a key with a set bit has the rank of that bit as its slot, so n keys have slots 0 to n-1. ``lookup`` seeks the
footer, a block of bits for each level tried (two on average, whatever the number of keys), one slot, one fingerprint and the ids
themselves; a fingerprint tells a key of the shard from others (but for 1 in 65,536), and then ``keys`` decides.

Shards are written in ascending key order: documents are range-partitioned by key and cut at ``SHARD_IDS`` ids. Documents of one
key are dealt on by a hash of their text and a row number, so that a key of any number of documents takes several tasks.
A null key is written as the least int64 and comes back as null; repeated keys each keep their row; a null text is empty; other
columns are not looked at; an empty table has no shards and reads as no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import NULL_ID, bounded_broadcast, by_bytes, key, prepare_workers, scratch_path, task, texts_of
from lakeloom.llm.encode import encoder
from lakeloom.llm.tokens import mix

SHARD_IDS = 1_000_000
#: Bytes of text for each range of keys; it bounds what a task sorts and writes.
RANGE_CHARS = 32_000_000
END_ID = 1
BLOCK_BITS = 512
#: Bytes of a worker's table of pieces.
TABLE_BYTES = 160_000_000
_FOOTER = struct.Struct("<8s7q")
FOOTER, MAGIC = _FOOTER.size, b"LOOMIDX3"
_ROW = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("value", pa.binary())])
_META = "part long, block long, n_ids long, n_docs long, first_key long, last_key long"


def _hashed(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + repeats.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def _print(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed + np.uint64(0x51ED270B)) >> np.uint64(48)).astype(np.uint16)


class PerfectHash:
    """Slots 0 to n-1 for n distinct hashes."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.begins = np.concatenate([[0], np.cumsum(levels.astype(np.int64))])
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, hashed: np.ndarray) -> PerfectHash:
        levels, bits, left, level = [], [], hashed, 0
        while len(left):
            size = 2 * len(left) + 1
            at = cls._place(left, level, size)
            own = np.bincount(at, minlength=size) == 1
            levels.append(size)
            bits.append(own)
            left, level = left[~own[at]], level + 1
        return cls(np.array(levels, np.int32), np.concatenate(bits) if bits else np.zeros(0, bool))

    @staticmethod
    def _place(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashed + np.uint64(level * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, hashed: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level has it."""
        out, left = np.full(len(hashed), -1, np.int64), np.arange(len(hashed))
        for level, size in enumerate(self.levels.tolist()):
            if not len(left):
                break
            at = self._place(hashed[left], level, size) + self.begins[level]
            here = self.bits[at]
            out[left[here]] = self.ranks[at[here]]
            left = left[~here]
        return out


class Layout:
    """Where the parts of a shard file are, by its footer (the last bytes before the line end)."""

    def __init__(self, footer: bytes):
        magic, self.part, self.block, self.n_ids, self.n_docs, self.n_levels, self.n_bits, self.width = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        blocks = -(-self.n_bits // BLOCK_BITS)
        self.levels = self.width * self.n_ids
        self.ranks = self.levels + 4 * self.n_levels
        self.bits = self.ranks + 8 * blocks
        self.slots = self.bits + blocks * BLOCK_BITS // 8
        self.prints = self.slots + 16 * self.n_docs
        self.keys = self.prints + 2 * self.n_docs
        self.repeats = self.keys + 8 * self.n_docs
        self.end = self.repeats + 4 * self.n_docs


def _shard(part: int, block: int, keys: list[int], texts: list[bytes], width: int) -> bytes:
    """A shard file of documents in key order."""
    k = np.array(keys, "<i8")
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    repeats = (np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))).astype("<i4")
    lengths = np.array([len(t) // width for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    hashed = _hashed(k, repeats)
    index = PerfectHash.build(hashed)
    slot = index.slots(hashed)
    slots, prints = np.zeros((len(k), 2), "<i8"), np.zeros(len(k), "<u2")
    slots[slot, 0], slots[slot, 1], prints[slot] = offsets, lengths, _print(hashed)
    bits = np.zeros(-(-len(index.bits) // BLOCK_BITS) * BLOCK_BITS, bool)
    bits[: len(index.bits)] = index.bits
    ranks = index.ranks[: len(bits) : BLOCK_BITS].astype("<i8")
    footer = _FOOTER.pack(MAGIC, part, block, int(lengths.sum()), len(k), len(index.levels), len(index.bits), width)
    tables = (index.levels.astype("<i4"), ranks, np.packbits(bits), slots, prints, k, repeats)
    return b"".join([*texts, *(t.tobytes() for t in tables), footer])


@task
def _written(path: str, kind: str, end_id: int, shard_ids: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, block, keys, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    enc = encoder(path, kind, TABLE_BYTES)
    width = enc.width() if end_id < 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()

    def out():
        meta = {"part": part, "block": block, "n_ids": held, "n_docs": len(keys), "first_key": keys[0], "last_key": keys[-1]}
        for what, value in (("shard", _shard(part, block, keys, texts, width)), ("meta", json.dumps(meta).encode())):
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((what, part, block, value), _ROW, strict=True)], schema=_ROW)

    for batch in by_bytes(batches, "text"):
        for k, ids in zip(batch.column(0).to_pylist(), enc.batch(texts_of(batch, "text")), strict=True):
            if keys and held + len(ids) // 4 + 1 > shard_ids:
                yield from out()
                block, keys, texts, held = block + 1, [], [], 0
            keys.append(k)
            texts.append((ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()) + end)
            held += len(ids) // 4 + 1
    if keys:
        yield from out()


class Shard:
    """A whole shard file in memory, for reading many documents."""

    def __init__(self, raw: memoryview):
        self.raw = raw[:-1]  # without the line end
        self.at = at = Layout(bytes(self.raw[len(self.raw) - FOOTER :]))
        take = lambda begin, end, kind: np.frombuffer(self.raw[begin:end], kind)
        bits = np.unpackbits(take(at.bits, at.slots, np.uint8), count=at.n_bits).astype(bool)
        self.index = PerfectHash(take(at.levels, at.ranks, "<i4"), bits)
        self.slots, self.prints = take(at.slots, at.prints, "<i8").reshape(-1, 2), take(at.prints, at.keys, "<u2")
        self.keys, self.repeats = take(at.keys, at.repeats, "<i8"), take(at.repeats, at.end, "<i4")

    def lookup(self, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) of each key; the offset is -1 where the fingerprint shows that the shard lacks it."""
        hashed = _hashed(keys, repeats)
        slot = self.index.slots(hashed)
        known = (slot >= 0) & (self.prints[slot] == _print(hashed)) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.slots[slot, 0], -1), np.where(known, self.slots[slot, 1], 0)


class Seeker:
    """Keyed access to a shard file by ``read(begin, n)`` alone: a constant number of small reads for each key."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.read = read
        self.at = at = Layout(read(size - 1 - FOOTER, FOOTER))
        self.levels = np.frombuffer(read(at.levels, 4 * at.n_levels), "<i4").tolist()

    def slot(self, hashed: np.ndarray) -> int:
        begin = 0
        for level, size in enumerate(self.levels):
            place = begin + int(PerfectHash._place(hashed, level, size)[0])
            block, rest = divmod(place, BLOCK_BITS)
            bits = np.unpackbits(np.frombuffer(self.read(self.at.bits + block * BLOCK_BITS // 8, BLOCK_BITS // 8), np.uint8))
            if bits[rest]:
                (rank,) = struct.unpack("<q", self.read(self.at.ranks + 8 * block, 8))
                return rank + int(bits[:rest].sum())
            begin += size
        return -1

    def ids(self, doc_key: int, repeat: int = 0) -> np.ndarray | None:
        """The ids of one document (end id and all), or None."""
        hashed = _hashed(np.array([doc_key], np.int64), np.array([repeat], np.int32))
        slot = self.slot(hashed)
        if slot < 0 or self.read(self.at.prints + 2 * slot, 2) != _print(hashed).astype("<u2").tobytes():
            return None
        offset, length = struct.unpack("<2q", self.read(self.at.slots + 16 * slot, 16))
        w = self.at.width
        return np.frombuffer(self.read(w * offset, w * length), f"<u{w}").astype("<u4")

    def copies(self, doc_key: int) -> int:
        """How many documents of this key the shard holds, by doubling and halving over repeats."""
        high = 1
        while high <= self.at.n_docs and self.ids(doc_key, high - 1) is not None:
            high *= 2
        low = high // 2
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if middle <= self.at.n_docs and self.ids(doc_key, middle - 1) is not None else (low, middle)
        return low


@task
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            raw = memoryview(content.as_buffer())
            shard = Shard(raw)
            offsets, lengths = shard.lookup(shard.keys, shard.repeats)
            if (offsets < 0).any():
                raise ValueError(f"shard {shard.at.part}/{shard.at.block}: its index lacks keys that it holds")
            ids = memoryview(np.frombuffer(raw[: shard.at.levels], f"<u{shard.at.width}").astype("<u4")).cast("B")
            crcs = [zlib.crc32(ids[4 * o : 4 * (o + n)]) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.keys == NULL_ID), pa.array(np.full(n, shard.at.part)), pa.array(np.full(n, shard.at.block)), pa.array(offsets), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "part", "block", "offset", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, tokenizer: str, kind: str = "word", out: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS, ranges: int | None = None) -> str:
    """Encode ``docs`` and write their shards to ``out`` (else a folder in the shared one); returns the folder."""
    spark = docs.sparkSession
    prepare_workers(spark)
    out = out or scratch_path(spark, "shards")
    texts = docs.select(key(F.col(id_col)).alias("k"), F.col(text_col).cast("string").alias("text"))
    if ranges is None:
        chars = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        ranges = max(1, -(-chars // RANGE_CHARS))
    # the columns after the key split a key of many documents
    dealt = texts.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")).repartitionByRange(int(ranges), "k", "h", "row").sortWithinPartitions("k", "h", "row").select("k", "text")
    made = dealt.mapInArrow(lambda it: _written(tokenizer, kind, end_id, shard_ids, it), "kind string, part long, block long, value binary")
    # the text writer puts the bytes of a row as they are, and a line end; a row has a folder of its own
    made.select("kind", "part", "block", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "part", "block").text(out)
    meta = spark.read.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(f"{out}/kind=meta") if _has_shards(spark, out) else None
    rows = meta.select(F.from_json("value", _META).alias("m")).select("m.*") if meta is not None else spark.createDataFrame([], _META)
    rows.write.mode("overwrite").parquet(f"{out}/manifest")
    return out


def _has_shards(spark, out: str) -> bool:
    """Whether the folder has shards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/kind=meta")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _before(sizes: DataFrame) -> DataFrame:
    """(part, block, base): the ids before each shard. Sums within parts, within groups of 1024 parts and over groups, so that the
    one task that sees all groups has a row for each 1024 tasks of the write."""
    group = F.floor(F.col("part") / 1024)
    running = lambda n, by, *at: F.sum(n).over(Window.partitionBy(*by).orderBy(*at)) - F.col(n)
    within = sizes.select("part", "block", running("n_ids", ["part"], "block").alias("a"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("g", group)
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"))
    groups = groups.select("g", running("n", [], "g").alias("c"))
    parts = parts.select("part", "g", running("n", ["g"], "part").alias("b")).join(groups, "g")
    return within.join(parts, "part").select("part", "block", (F.col("a") + F.col("b") + F.col("c")).alias("base"))


def read_shards(spark, path: str) -> DataFrame:
    """A row per document from the shards: ``doc_id, start`` (ids before it), ``n_tokens, ids_crc32, part, block, offset``."""
    prepare_workers(spark)
    columns = "doc_id long, part long, block long, offset long, n_tokens long, ids_crc32 long"
    if not _has_shards(spark, path):
        rows = spark.createDataFrame([], columns)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/kind=shard")
        rows = files.select("content").mapInArrow(_read, columns)
    starts = bounded_broadcast(_before(spark.read.schema(_META).parquet(f"{path}/manifest")))
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "block", "offset")


def open_shard(spark, path: str, part: int, block: int) -> Seeker:
    """A shard on any Hadoop file system, read by seeking."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=shard/part={part}/block={block}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    (file,) = [f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".txt")]
    stream = fs.open(file.getPath())

    def read(begin: int, n: int) -> bytes:
        stream.seek(begin)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    return Seeker(file.getLen(), read)


def lookup(spark, path: str, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
    """The ids of one document, or of the ``repeat``-th more of its key: the shards whose key range holds it, by the manifest, then
    seeks by their index."""
    k = NULL_ID if doc_id is None else doc_id
    held = spark.read.schema(_META).parquet(f"{path}/manifest").filter((F.col("first_key") <= k) & (F.col("last_key") >= k)).orderBy("part", "block")
    for row in held.toLocalIterator():
        shard = open_shard(spark, path, row["part"], row["block"])
        found = shard.ids(k, repeat)
        if found is not None:
            return found
        repeat -= shard.copies(k)
    return None
