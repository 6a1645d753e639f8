"""Landing of CSV, JSON and JSON-lines files as payload maps that keep each row's own keys.

A reader that merges headers or infers a schema would hide drift: two files whose headers differ, or a JSON row with a key of
its own. So each file keeps its header and each row its keys: ``source_file, pos, payload map<string,string>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _file() -> F.Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _require(spark: SparkSession, glob: str) -> None:
    """Zero matches are an error, with the pattern in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"no files match {glob}")


def _cells(record) -> F.Column:
    """The fields of a CSV record: commas outside quotes separate them, and a doubled quote in quotes is one."""
    fields = F.split(record, ',(?=(?:[^"]*"[^"]*")*[^"]*\\z)', -1)
    return F.transform(fields, lambda x: F.regexp_replace(F.regexp_replace(x, '\\A"|"\\z', ""), '""', '"'))


def _records(lines: DataFrame) -> DataFrame:
    """``source_file, place, value`` of whole records: a line that begins within quotes goes on with the record before it. One file's
    lines are numbered in one task, sorted on disk where they are many."""
    order = Window.partitionBy("source_file").orderBy("place")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    within = F.coalesce(F.sum(quotes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    marked = lines.withColumn("within", within)
    numbered = marked.withColumn("record", F.sum(F.when(F.col("within"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("place", "value")))
    records = numbered.groupBy("source_file", "record").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return records.select("source_file", F.col("parts")[0]["place"].alias("place"), F.regexp_replace(text, "\r\\z", "").alias("value"))


def read_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Every file's records by its own header; quoted fields may hold line ends. A record with fewer fields than the header lacks the
    last keys, fields beyond the header are dropped, and blank lines are skipped."""
    lines = spark.read.option("lineSep", "\n").text(glob)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place")
    records = _records(lines.select(_file().alias("source_file"), "value", place)).filter(F.length(F.trim("value")) > 0)
    # a file's first record is its header: small, one a file
    header = records.groupBy("source_file").agg(F.min_by("value", "place").alias("header"), F.min("place").alias("first"))
    body = records.join(header, "source_file").filter(F.col("place") > F.col("first"))
    names, values = _cells(F.col("header")), _cells(F.col("value"))
    n = F.least(F.size(names), F.size(values))
    return body.select("source_file", "place", F.map_from_arrays(F.slice(names, 1, n), F.slice(values, 1, n)).alias("payload"))


def read_json_array(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of JSON documents that are arrays of objects; another document is an error that names the file."""
    docs = spark.read.text(glob, wholetext=True).select(_file().alias("source_file"), "value")
    rows = F.from_json("value", "array<map<string,string>>")
    checked = F.when(F.ltrim("value").startswith("[") & rows.isNotNull(), rows).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), "source_file")).cast("array<map<string,string>>"))
    return docs.select("source_file", F.posexplode(checked).alias("p", "payload")).select("source_file", F.struct(F.lit(0).cast("long").alias("block"), F.col("p").cast("long").alias("at")).alias("place"), "payload")


def read_jsonl(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, nested objects stay JSON text."""
    lines = spark.read.text(glob).select(_file().alias("source_file"), "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    return lines.filter(F.length(F.trim("value")) > 0).select("source_file", "place", F.from_json("value", "map<string,string>").alias("payload"))


READERS = {"csv": read_csv, "json": read_json_array, "jsonl": read_jsonl}


def land(spark: SparkSession, file_format: str, glob: str) -> DataFrame:
    """``source_file, place, payload`` of all files that match; ``place`` orders the rows of a file."""
    if file_format not in READERS:
        raise ValueError(f"unknown file format {file_format!r}; known: {', '.join(READERS)}")
    _require(spark, glob)
    return READERS[file_format](spark, glob)
