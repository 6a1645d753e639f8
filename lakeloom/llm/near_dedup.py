"""Near-duplicates by Order MinHash over runs of five words, verified by banded alignment of runs and words.

Of every document the occurrence-labelled runs of five words are hashed under ``SKETCHES`` permutations. A sketch is the ``ROWS`` runs
with least hashes, kept in text order, so documents agree in it only if they share these runs in the same order.

Copies (same words) are first collapsed to one node. Nodes that agree in a sketch are candidates. In groups of up to
``SMALL`` nodes all pairs are taken. In larger groups each member is compared with the most central one. The groups whose
members are then still in different classes are finished exactly, by what is rare in them: with the occurrence-labelled runs of each
node in one order, the rarest first, two nodes can only link by their runs if they share one among the first of both (as many as a
link leaves unaligned, and one), and likewise by their words. So nodes are joined on these, and pairs of one class are left out, as
are those whose bits differ in more places than a link leaves words unaligned: a node has ``BITS`` parities of its words, and each
word that only one of two nodes has changes one parity.
Passages that many documents share are not among their rarest runs, so work grows with the documents and not with the square of a
group's size.

A candidate pair is a link if its aligned runs of five words make up ``SIMILARITY`` of all runs of both (common / (n + m - common)), or
its aligned words ``WORD_SIMILARITY`` of all words. The first holds for copies that lost or gained a passage; the second for
copies with words changed here and there, each of which alters five runs. Alignments keep the order, and aligned places are no
further apart than a link allows. Classes are the connected components of the links.

Defined results: texts without a word (null, empty, punctuation) are alone in their class; a text of one to four words has one
run of all its words; repeated rows share a class; rows with null id count as copies like others; other columns stay out.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import ROW, ROW_TYPE, bounded_broadcast, by_bytes, cut, key, numbered, prepare_workers, task, temporary, texts_of, without
from lakeloom.llm.tokens import labelled, mix, shingles, words

RUN, SIMILARITY, WORD_SIMILARITY = 5, 0.8, 0.9
#: Pairs that link agree in 0.6 of their runs or more, unless they are short: a sketch of three agrees in one of five.
SKETCHES, ROWS = 24, 3
SMALL = 32
#: Pairs of one node that are verified in one task; those of a node with more are dealt to several.
SALT_ROWS = 250
#: Levels of counts of runs, kept in every worker (16 MB), whatever the size of the input.
COUNTERS, BLOCK = 1 << 24, 1 << 12
_SEEDS = [np.uint64(int.from_bytes(hashlib.blake2b(b"order-minhash %d" % i, digest_size=8).digest(), "little")) for i in range(SKETCHES)]
_TOP = np.uint64(2**64 - 1)


def sketches(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SKETCHES values for each text; ``runs`` are labelled, ``first`` has the first run of each text."""
    counts = np.diff(first)
    full = np.flatnonzero(counts > 0)
    out = np.zeros((len(counts), SKETCHES), np.uint64)
    if not len(full):
        return out
    begins, sizes = first[:-1][full], counts[full]
    for i, seed in enumerate(_SEEDS):
        ranks = mix(runs ^ seed)
        places = np.full((len(full), ROWS), -1, np.int64)
        for r in range(ROWS):
            least = np.minimum.reduceat(ranks, begins)
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            text = np.searchsorted(begins, at, side="right") - 1
            places[text[::-1], r] = at[::-1]  # of equal ranks the first place
            ranks[places[:, r]] = _TOP
            places[sizes <= r, r] = -1
        places.sort(axis=1)
        value = np.full(len(full), i + 1, np.uint64)
        for r in range(ROWS):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(places[:, r] >= 0, runs[places[:, r]], np.uint64(r)))
        out[full, i] = value
    return out


def _digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    return [hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@task
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        own, first = words(texts_of(batch, "text"))
        runs, run_first = shingles(own, first, RUN)
        rows = sketches(labelled(runs, run_first), run_first).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_digests(own, first), pa.binary()), pa.array(np.diff(first)), pa.array(list(rows), pa.list_(pa.int64()))], names=[ROW, "doc_id", "node", "n", "sketch"])


@task
def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        own, first = words(texts_of(batch, "text"))
        low = own.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(_digests(own, first), pa.binary()), pa.array([low[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["node", "words"])


def needed(n: int, m: int, least: float) -> float:
    """Words in common that a link of n and m words has at least."""
    return least * (n + m) / (1 + least) - 1e-9


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The longest common subsequence of two texts over all words of both, or 0.0 if it is under ``least``.

    The dynamic programme keeps a row as the bits of one number, so a word costs a few operations on it; only words within the band
    match, as a link leaves no more words unaligned. Equal words at both ends are aligned at once."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = needed(n, m, least)
    band = int(n + m - 2 * need)
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    common = head + tail
    if a and b:
        places: dict[int, int] = {}
        for j, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << j
        full = (1 << len(b)) - 1
        row, window = full, (1 << (2 * band + 1)) - 1
        for i, w in enumerate(a):
            at = places.get(w)
            if at is None:
                continue
            # places i - band to i + band of b
            own = row & at & (window << (i - band) if i >= band else window >> (band - i))
            if own:
                row = ((row + own) | (row - own)) & full
        common += len(b) - row.bit_count()
    return common / (n + m - common) if common >= need else 0.0


def aligned_runs(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned labelled runs in common over all runs of both, or 0.0 if under ``least``. Runs of one text are distinct, so the alignment is
    the longest increasing chain of matched places."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = needed(n, m, least)
    order = np.argsort(b, kind="stable")
    place = order[np.minimum(np.searchsorted(b, a, sorter=order), m - 1)]
    chain = place[(b[place] == a) & (np.abs(place - np.arange(n)) <= n + m - 2 * need)]
    tails: list[int] = []
    if len(chain) >= need:
        for x in chain.tolist():
            if not tails or x > tails[-1]:
                tails.append(x)
            else:
                tails[bisect_left(tails, x)] = x
    return len(tails) / (n + m - len(tails)) if tails and len(tails) >= need else 0.0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of words of two texts that link, or 0.0. A link by runs has as many words in common, so words come first."""
    sim = aligned(a, b, SIMILARITY)
    if not sim or sim >= WORD_SIMILARITY - 1e-9:
        return sim
    ra, rb = (_labelled(*shingles(x.astype(np.uint64), np.array([0, len(x)]), RUN)) for x in (a, b))
    return sim if aligned_runs(ra, rb) else 0.0


def _flat(col: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows of ``col`` one after another, and where each row's begin and end."""
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32), (ends - ends[0]) // 4


#: What pairs may link by: runs of so many words, and the similarity that they need in these.
KINDS = ((RUN, SIMILARITY), (1, WORD_SIMILARITY))
BITS = 512


def parities(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BITS parities of the labelled words of each text, as 64-bit integers."""
    n = len(ends) - 1
    text = np.repeat(np.arange(n), np.diff(ends))
    odd = np.bincount(text * BITS + _labelled(flat, ends) % np.uint32(BITS), minlength=n * BITS) & 1
    return np.packbits(odd.astype(bool).reshape(n, BITS), axis=1).view(np.int64)


def _labelled(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that differ by occurrence within their text, 32 bits each."""
    return labelled(flat.astype(np.uint64), ends).astype(np.uint32)


def _features(k: int, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labelled runs of k words of texts of words, and where each text's begin and end."""
    runs, first = shingles(flat.astype(np.uint64) + np.uint64(k << 32), ends, k)
    return _labelled(runs, first), first


def level(counts: np.ndarray) -> np.ndarray:
    """Counts in eight bits: exact to 15, then eight to an octave."""
    more = 15 + np.floor(8 * np.log2(np.maximum(counts, 1) / 15 + 1e-9))
    return np.where(counts <= 15, counts, np.clip(more, 15, 255)).astype(np.uint8)


@task
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counters, counts): the counters that a task's texts reach, a row for each BLOCK of them."""
    at, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    new: list[np.ndarray] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        more, counts = np.unique(np.concatenate(new) if new else np.zeros(0, np.uint32), return_counts=True)
        both, of = np.unique(np.concatenate([at, more]), return_inverse=True)
        return both, np.bincount(of, np.concatenate([n, counts]), minlength=len(both)).astype(np.int64)

    for batch in (part for whole in batches for part in by_bytes([whole], "words")):
        flat, ends = _flat(batch.column(0))
        new += [_features(k, flat, ends)[0] & np.uint32(COUNTERS - 1) for k, _ in KINDS]
        if sum(map(len, new)) > 2_000_000:
            at, n = summed()
            new.clear()
    at, n = summed()
    edge = np.searchsorted(at, np.arange(0, COUNTERS + 1, BLOCK)).tolist()
    full = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in full], pa.int32()), pa.array([at[a:b].astype("<u4").tobytes() for _, a, b in full], pa.binary()), pa.array([n[a:b].astype("<i8").tobytes() for _, a, b in full], pa.binary())], names=["block", "counters", "counts"])


@task
def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, levels): the levels of a block's counts over all tasks."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, of, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            held.setdefault(i, np.zeros(BLOCK, np.int64))[np.frombuffer(of, "<u4") % BLOCK] += np.frombuffer(n, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([level(x).tobytes() for x in held.values()], pa.binary())], names=["block", "levels"])


_RARE = ["value", "k", "node", "root", "n", "at", "words", *(f"p{i}" for i in range(BITS // 64))]


@task
def _rarest(batches: Iterator[pa.RecordBatch], often: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes([whole], "words")):
        flat, ends = _flat(batch.column(2))
        odd = parities(flat, ends)
        for k, least in KINDS:
            value, first = _features(k, flat, ends)
            n = np.diff(first)
            text, c = np.repeat(np.arange(len(n)), n), often[value & np.uint32(COUNTERS - 1)]
            order = np.lexsort((value, c, text))
            at = np.arange(len(value)) - np.repeat(first[:-1], n)
            kept = (at <= np.repeat(np.floor(n * (1 - least) + 1e-6), n)) & (c[order] > 1)  # what is counted once matches none
            of = pa.array(text[kept])
            yield pa.RecordBatch.from_arrays([pa.array(value[order][kept].view(np.int32)), pa.array(np.full(len(of), k, np.int32)), batch.column(0).take(of), batch.column(1).take(of), pa.array(n[text[kept]]), pa.array(at[kept]), pa.array(np.diff(ends)[text[kept]]), *(pa.array(x) for x in odd[text[kept]].T.copy())], names=_RARE)


@task
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes(by_bytes([whole], "words_u"), "words_v")):
        (a, at_a), (b, at_b) = _flat(batch.column(2)), _flat(batch.column(3))
        n, m = np.diff(at_a), np.diff(at_b)
        pair = np.arange(len(n), dtype=np.uint64) << np.uint64(32)
        # words in common, whatever their places, are no fewer than those aligned: most pairs that are no link end here
        both = np.concatenate([np.repeat(pair, n) | _labelled(a, at_a), np.repeat(pair, m) | _labelled(b, at_b)])
        both.sort()
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(n))
        sims = np.zeros(len(n))
        for k in np.flatnonzero(common >= needed(n, m, SIMILARITY)).tolist():
            sims[k] = similarity(a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["u", "v", "sim"])


def _with_side(pairs: DataFrame, side: str, other: str, texts: DataFrame) -> DataFrame:
    """``pairs`` with the words of one side. A node of many pairs (the centre of a large group) has a copy of its words for each
    SALT_ROWS of them, and its pairs are dealt to the copies."""
    hot = cut(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SALT_ROWS), "hot")
    hot = bounded_broadcast(hot.select(side, F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("copies")))
    salted = pairs.join(hot, side, "left").withColumn("salt", F.coalesce(F.pmod(F.hash(other), F.col("copies")), F.lit(0))).drop("copies")
    own = texts.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")).join(hot, side, "left")
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return salted.join(own, [side, "salt"]).drop("salt")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, sim) of all ``pairs`` (stored), with the alignment done from the stored words of both."""
    both = _with_side(_with_side(pairs, "u", "v", texts), "v", "u", texts)
    return both.select("u", "v", "words_u", "words_v").mapInArrow(_verified, "u binary, v binary, sim double")


def _pairs_within(rows: DataFrame, on: list[str]) -> DataFrame:
    """All pairs of the nodes of each (small) group whose numbers of words allow a link."""
    a, b = rows.select(*on, F.col("node").alias("u"), F.col("n").alias("nu")), rows.select(*on, F.col("node").alias("v"), F.col("n").alias("nv"))
    return a.join(b, on).filter(F.col("u") < F.col("v")).filter((F.least("nu", "nv") >= SIMILARITY * F.greatest("nu", "nv"))).select("u", "v").distinct()


def _grouped(rows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of 2 to SMALL nodes, and those of larger groups. Sizes are stored before the join, and the join
    before any other: joins of plain shuffles are dealt anew where a group is large."""
    sizes = cut(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    sized = cut(rows.join(sizes, on), "sized")
    return sized.filter(F.col("size") <= SMALL), sized.filter(F.col("size") > SMALL)


def _to_hubs(rows: DataFrame) -> DataFrame:
    """(u, v): of each group g its most central member (whose groups have most members, then the greatest node) with the others."""
    central = rows.groupBy("node").agg(F.sum("size").alias("c"))
    hubs = rows.join(central, "node").groupBy("g").agg(F.max(F.struct("c", "node", "n")).alias("h")).select("g", F.col("h.node").alias("hub"), F.col("h.n").alias("nh"))
    hubs = bounded_broadcast(cut(hubs, "hubs"))
    asked = rows.join(hubs, "g").filter(F.col("node") != F.col("hub")).filter(F.least("n", "nh") >= SIMILARITY * F.greatest("n", "nh"))
    return asked.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _by_rarest(groups: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """(u, v): the pairs of nodes of ``groups`` (g, node) not in one class by ``links`` that share a run or a word among the rarest of
    both, so all of them that can link. The order is by levels of COUNTERS counts that values of one low part share: any order that is
    the same for all nodes finds all pairs, so only the work depends on them."""
    placed = groups.select("g", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("g")
    mixed = bounded_broadcast(cut(mixed, "mixed-groups"))
    nodes = placed.join(mixed, "g", "left_semi").select("node", "root").distinct()
    own = cut(nodes.join(texts, "node").select("node", "root", "words"), "mixed")
    counts = own.select("words").mapInArrow(_counted, "block int, counters binary, counts binary").repartition("block").mapInArrow(_levels, "block int, levels binary")
    often = np.zeros(COUNTERS, np.uint8)
    for r in counts.toLocalIterator():  # COUNTERS / BLOCK rows at most
        often[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(often)
    first = cut(own.mapInArrow(lambda it: _rarest(it, shared.value), "value int, k int, node binary, root binary, n long, at long, words long" + "".join(f", {x} long" for x in _RARE[7:])), "rare")
    shared.destroy()
    x, y = (first.select("value", "k", *[F.col(c).alias(c + side) for c in _RARE[2:]]) for side in "uv")
    # what both kinds of links have in common of runs or words, and leave unaligned of words: by runs they have 0.8 of words too
    share = F.coalesce(*[F.when(F.col("k") == k, least / (1 + least)) for k, least in KINDS])
    need = share * (F.col("nu") + F.col("nv")) - 1e-6
    able = (F.col("atu") <= F.col("nu") - need) & (F.col("atv") <= F.col("nv") - need)
    differ = functools.reduce(operator.add, [F.bit_count(F.col(f"{p}u").bitwiseXOR(F.col(f"{p}v"))) for p in _RARE[7:]])
    near = differ <= (F.col("wordsu") + F.col("wordsv")) * (1 - 2 * share) + 1e-6
    both = x.join(y, ["value", "k"]).filter((F.col("nodeu") < F.col("nodev")) & (F.col("rootu") != F.col("rootv")) & able & near)
    return both.select(F.col("nodeu").alias("u"), F.col("nodev").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node with a link the least node of its component. ``edges``: u, v. Alternates the large-star
    and small-star steps, each cut by a table in the shared folder, until nothing changes."""
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))  # of x the lesser neighbours y
        lowest = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(lowest, "x").select(F.col("m").alias("u"), "y", "x").select(F.explode(F.array(F.struct("u", F.col("y").alias("v")), F.struct("u", F.col("x").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = cut(small, "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before or not state["n"]:
            break
        before = (state["n"], state["s"])
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``doc_id, class_id`` (the least id of its class), ``class_size`` (rows), ``n_links`` (verified
    links of its text to other texts) and ``kept`` (one row of each class: of those with the least id, or of all if no id is
    known, the first)."""
    with temporary(docs.sparkSession):
        classes = _row_classes(docs, F.monotonically_increasing_id(), id_col, text_col).drop(ROW)
        return cut(classes, "classes", outer=True)


def _row_classes(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    """``near_classes`` with the column ROW; ``row`` numbers the rows of ``docs``."""
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = docs.select(row.cast(ROW_TYPE).alias(ROW), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(given.mapInArrow(_sketched, f"{ROW} {ROW_TYPE}, doc_id long, node binary, n long, sketch array<long>"), "sketches")
    members = rows.select(ROW, "doc_id", "node")
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    keyed = nodes.select("node", "n", F.posexplode("sketch").alias("i", "a"))
    small, large = _grouped(keyed, ["i", "a"])
    pairs = cut(_pairs_within(small, ["i", "a"]), "pairs")

    # the words of the nodes that have candidates
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(large.select("node")).distinct()
    ids = cut(nodes.join(wanted, "node", "left_semi").select(key(F.col("rep")).alias("k")).distinct(), "ids")
    own = texts.join(bounded_broadcast(ids), key(texts["doc_id"]) == ids["k"], "left_semi").select("text")
    own = own.mapInArrow(_with_words, "node binary, words binary").filter("node is not null")
    own = cut(own.groupBy("node").agg(F.first("words").alias("words")), "words")

    links = cut(_links(pairs, own).filter("sim > 0").select("u", "v"), "links")
    if large.take(1):
        groups = large.withColumn("g", F.xxhash64("i", "a"))
        hubs = cut(_to_hubs(groups), "hub-pairs")
        links = cut(links.unionByName(_links(hubs, own).filter("sim > 0").select("u", "v")).distinct(), "links")
        rare = cut(_by_rarest(groups, own, links), "rare-pairs")
        links = cut(links.unionByName(_links(rare, own).filter("sim > 0").select("u", "v")).distinct(), "links")

    roots = components(links)
    degree = links.select("u", "v").distinct().select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classed = nodes.select("node", "rep", "first", "rows").join(roots, "node", "left").join(degree, "node", "left").select("node", "rep", "first", "rows", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classed = cut(classed, "classed")
    # of classes of several nodes: one of many nodes doesn't meet in one task, as its row is broadcast or AQE splits the join
    sizes = classed.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("first").alias("least"), F.sum("rows").alias("class_size"), F.count(F.lit(1)).alias("m"))
    sizes = bounded_broadcast(cut(sizes.filter("m > 1").drop("m"), "class-sizes"))
    classed = classed.join(sizes, "root", "left")
    stays = F.coalesce(F.col(f"least.{ROW}"), F.col(f"first.{ROW}")).alias("stays")
    classed = classed.select("node", F.coalesce(F.when(F.col("least").isNotNull(), F.col("class_id")), "rep").alias("class_id"), stays, F.coalesce("class_size", "rows").alias("class_size"), "n_links")
    out = members.join(classed, "node", "left")
    return out.select(ROW, "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col(ROW) == F.col("stays"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class; all columns stay."""
    docs = numbered(docs)
    with temporary(docs.sparkSession):
        gone = cut(_row_classes(docs, F.col(ROW), id_col, text_col).filter("not kept").select(ROW), "gone", outer=True)
    return without(docs, gone)
