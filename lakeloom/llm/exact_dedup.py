"""Stateful streaming deduplication of exact copies, with DataFrame and SQL functions only.

Texts are equal when identical after deleting white space (U+0020, U+0009 to U+000D). A ``Deduplicator`` takes documents in any
number of additions and keeps all it knows in a folder, so it goes on after a restart. For each addition it

1. appends their digests to a table of (digest, length, id, locator), where the locator is the file and row of the content;
2. runs the stream over that table from its checkpoint, in micro-batches of at most ``BATCH_BYTES`` of files. Keyed state without
   expiry, held on disk by the RocksDB state store, retains for each digest the group's size, the stable identifier (id) and the
   content locator of the text that stays: of equal texts the one with most code points in the original text, then the least id;
3. checks every hit of the addition (a row whose digest another row has) by its full bytes against the text that stays; both are read
   by their locators. Rows with the same digest and other bytes are set aside and form groups of their own. Where an addition
   brings a text that stays in place of an earlier one, all earlier rows of its digest are checked again, and other bytes among
   them (two texts of one SHA-256 digest) are an error.

A marker ends each addition; one that a crash cut short is completed by the next.

Texts that stay are dealt out once for every ``SALT_ROWS`` rows of their group and its rows by a hash of their locators, so that a large
group doesn't meet in one task, whatever its ids.

Defined results: a null text counts as empty; all empty texts are equal; repeated rows (same id and text) are members of the
group like others and one of them stays; a null id counts as less than all others; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import bounded_broadcast, cut, scanned, scratch_path, temporary

SALT_ROWS = 1000
#: Bytes of the digest table (some 100 a document) that a micro-batch takes.
BATCH_BYTES = 64_000_000
_SPACES = " \t\n\x0b\x0c\r"
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # without it each of many small stores sets megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_DIGESTS = "doc_id bigint, sha string, digest string, length bigint, file string, at bigint, wave int"
_STATE = "digest string, size bigint, keep struct<negative: bigint, doc_id: bigint, file: string, at: bigint, wave: int>, batch bigint"
_OTHER = "file string, at bigint, doc_id bigint, digest string, length bigint, normal string"


def _normal(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``__file`` and ``__at`` that locate each row's content: those of a table read as it is, or else of a
    copy of the rows in the shared folder."""
    if not scanned(docs):
        docs = cut(docs, "documents", outer=True)
    return docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))


class Deduplicator:
    """Deduplication whose state lives in ``folder``. ``digest_digits`` shortens the digest by which the state is keyed (for tests of the
    check of full bytes); it and ``batch_bytes`` bind a folder's first addition and all others."""

    def __init__(self, spark: SparkSession, folder: str, digest_digits: int = 64, batch_bytes: int = BATCH_BYTES):
        self.spark, self.folder, self.digits, self.batch_bytes = spark, folder.rstrip("/"), digest_digits, batch_bytes

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def digests(self) -> DataFrame:
        return self._read("digests", _DIGESTS)

    def state(self) -> DataFrame:
        """(digest, size, keep) after all that the stream has taken."""
        return self._read("state", _STATE).groupBy("digest").agg(F.max_by(F.struct("size", "keep"), "batch").alias("s")).select("digest", "s.*")

    def _waves(self, name: str) -> set[int]:
        """The additions of which a folder holds something."""
        if not self._exists(name):
            return set()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return {int(s.getPath().getName().split("=")[1]) for s in found if "=" in s.getPath().getName()}

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take ``docs`` (located). Files that were taken before aren't taken again."""
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("__file").alias("file"), F.col("__at").alias("at"))
        sha = F.sha2(_normal(F.col("text")), 256).alias("sha")
        length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("length")
        wave = max(self._waves("digests"), default=-1) + 1
        rows = texts.select("doc_id", sha, length, "file", "at").withColumn("digest", F.substring("sha", 1, self.digits))
        if wave:
            files = cut(self.digests().select("file").distinct(), "known-files")
            rows = rows.join(bounded_broadcast(files), "file", "left_anti")
        rows = rows.select("doc_id", "sha", "digest", "length", "file", "at", F.lit(wave).cast("int").alias("wave"))
        rows.write.parquet(f"{self.folder}/digests/part={wave}")
        self._run()
        for w in sorted(self._waves("digests") - self._waves("checked")):
            with temporary(self.spark):
                self._check(w, T.StructType([docs.schema[text_col]]))

    def _run(self) -> None:
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in _STORE}
        try:
            for k, v in _STORE.items():
                spark.conf.set(k, v)
            stream = spark.readStream.schema(_DIGESTS).option("recursiveFileLookup", "true").option("maxBytesPerTrigger", self.batch_bytes).parquet(f"{self.folder}/digests")
            kept = F.min(F.struct((-F.col("length")).alias("negative"), "doc_id", "file", "at", "wave")).alias("keep")
            state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), kept)

            def store(batch: DataFrame, n: int) -> None:
                batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/state/part={n}")

            query = state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def _check(self, wave: int, schema: T.StructType) -> None:
        """Compare the full bytes of all hits of an addition with the text that stays, and append rows with other bytes to ``other``.
        ``schema`` has the column of texts alone."""
        hits = self.state().filter("size > 1")
        hits = cut(hits.select("digest", F.ceil(F.col("size") / SALT_ROWS).alias("salts"), F.col("keep.file").alias("f"), F.col("keep.at").alias("a"), (F.col("keep.wave") == wave).alias("moved")), "dedup-hits")
        stays = (F.col("file") == F.col("f")) & (F.col("at") == F.col("a"))
        places = self.digests().join(bounded_broadcast(hits), "digest").filter((F.col("wave") == wave) | F.col("moved") & (F.col("wave") < wave) | stays)
        places = cut(places.select("file", "at", "doc_id", "length", "digest", "salts", "wave", stays.alias("stays")), "dedup-places")
        files = [r["file"] for r in places.select("file").distinct().toLocalIterator()]  # as many as a scan of the contents lists
        if files:
            contents = self.spark.read.schema(schema).parquet(*files)
            contents = contents.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(schema[0].name).cast("string").alias("text"))
            asked = contents.join(bounded_broadcast(places), ["file", "at"]).withColumn("normal", _normal(F.col("text"))).drop("text")
            kept = asked.filter("stays").select("digest", F.col("normal").alias("kept_normal"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
            asked = asked.filter("not stays").withColumn("salt", F.pmod(F.xxhash64("file", "at"), F.col("salts")))
            other = cut(asked.join(kept, ["digest", "salt"]).filter("normal <> kept_normal"), "dedup-other")
            if other.filter(F.col("wave") < wave).take(1):
                raise ValueError("a digest stands for two texts, of which a later addition displaced the one that stayed")
            other.select("file", "at", "doc_id", "digest", "length", "normal").write.mode("append").parquet(f"{self.folder}/other")
        self.spark.range(1).write.parquet(f"{self.folder}/checked/wave={wave}")

    def groups(self) -> DataFrame:
        """A row per row added: ``file, at, doc_id, keep_id, group_size, kept, text_sha256``."""
        rows, state = self.digests(), cut(self.state(), "dedup-kept")
        is_kept = (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))
        out = rows.join(state, "digest").select("file", "at", "doc_id", "sha", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), is_kept.alias("kept"))
        other = self._read("other", _OTHER)
        if other.take(1):  # equal digests of unequal texts: groups by the texts themselves
            out = self._split(out, other)
        return out.select("file", "at", "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))

    def _split(self, out: DataFrame, other: DataFrame) -> DataFrame:
        first = F.min(F.struct((-F.col("length")).alias("negative"), "doc_id", "file", "at")).alias("k")
        own = other.groupBy("digest", "normal").agg(F.count(F.lit(1)).alias("n"), first)
        is_kept = (F.col("file") == F.col("k.file")) & (F.col("at") == F.col("k.at"))
        fixed = other.join(own, ["digest", "normal"]).select("file", "at", "n", F.col("k.doc_id").alias("k_id"), is_kept.alias("k_kept"))
        less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
        both = out.join(fixed, ["file", "at"], "left").join(less, "digest", "left")
        is_own = F.col("n").isNotNull()
        size = F.when(is_own, F.col("n")).otherwise(F.col("group_size") - F.coalesce("gone", F.lit(0)))
        return both.select("file", "at", "doc_id", "sha", "digest", F.when(is_own, F.col("k_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), F.when(is_own, F.col("k_kept")).otherwise(F.col("kept")).alias("kept"))


def _groups(docs: DataFrame, id_col: str, text_col: str, digest_digits: int, batch_bytes: int, folder: str | None) -> DataFrame:
    spark = docs.sparkSession
    dedup = Deduplicator(spark, folder or scratch_path(spark, "dedup"), digest_digits, batch_bytes)
    dedup.add(docs, id_col, text_col)
    return dedup.groups()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_digits: int = 64, batch_bytes: int = BATCH_BYTES, folder: str | None = None) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``. With ``folder`` the state stays there, and the result
    covers what was added to it before too."""
    return _groups(located(docs), id_col, text_col, digest_digits, batch_bytes, folder).drop("file", "at")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that equal one that stays, told by their locators; all their columns stay."""
    placed = located(docs)
    found = _groups(placed, id_col, text_col, 64, BATCH_BYTES, None)
    gone = cut(found.filter("not kept").select(F.col("file").alias("__file"), F.col("at").alias("__at")), "gone")
    return placed.join(bounded_broadcast(gone), ["__file", "__at"], "left_anti").select(*docs.columns)
