"""Raw telemetry files: scan, admission, encodings, one schema for all headers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .columns import VARIANTS, mapping

MIN_COLUMNS = 3
TEXT_COLUMNS = {"timestamp", "vehicle_number", "driver_rating"}
#: Bytes of paths that are sent to every task, at most.
PATH_BYTES = 1 << 26


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes (of the file), start (first byte of the split), place (grows inside a split), line of every CSV file below folder.

    A file is read in splits, so its size doesn't matter; a line is what its bytes
    are, whatever their encoding. Files of 0 bytes have no line.
    """
    raw = _reader(spark, folder)
    meta = F.col("_metadata")
    return raw.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def _reader(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").text(folder)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path of every CSV file below folder, also of those of 0 bytes, which no scan returns.

    The list is that of Spark's own file index, which lists large trees by a job; it
    becomes a table inside the JVM and never passes through Python.
    """
    jvm = spark._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(_reader(spark, folder)._jdf.inputFiles())
    table = DataFrame(spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # the index says file:///, a line's metadata file:/
    return table.select(F.regexp_replace("value", "^file:/+", "file:/").alias("path"))


def _decoded(raw: Column, encoding: Column) -> Column:
    return F.when(encoding == "ISO-8859-1", F.decode(raw.cast("binary"), "ISO-8859-1")).otherwise(raw)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each CSV file below folder: path, bytes, n_rows, encoding, header and why it is not admitted, if so.

    One aggregation over the lines, a row for each file and task before the shuffle:
    the first line, how many are not blank, and whether all are valid UTF-8 (else the
    file is read as ISO-8859-1). The header is the first line, however long; a file is
    empty if only blank lines follow it. One of 0 bytes has neither header nor encoding.
    """
    told = lines(spark, folder).groupBy("path").agg(
        F.max("bytes").alias("bytes"),
        F.min_by("line", F.when(F.col("start") == 0, F.col("place"))).alias("first"),
        F.count_if(F.col("line").rlike(r"\S")).alias("n_lines"),
        F.bool_and(F.expr("is_valid_utf8(line)")).alias("valid"),
    )
    rows = listed(spark, folder).join(told, "path", "left")
    encoding = F.when(F.col("valid"), "UTF-8").when(~F.col("valid"), "ISO-8859-1")
    n_rows = F.greatest(F.col("n_lines") - F.col("first").rlike(r"\S").cast("long"), F.lit(0))
    rows = rows.withColumns({"encoding": encoding, "n_rows": F.coalesce(n_rows, F.lit(0).cast("long")), "bytes": F.coalesce("bytes", F.lit(0).cast("long"))})
    rows = rows.withColumn("header", F.regexp_replace(_decoded(F.col("first"), F.col("encoding")), "^\ufeff", ""))
    reason = F.when(F.col("bytes") == 0, "zero bytes").when(F.col("n_rows") == 0, "empty").when(F.size(F.split("header", ",")) < MIN_COLUMNS, "too few columns")
    return rows.select("path", "bytes", "n_rows", "encoding", "header", reason.alias("reject_reason"))


def cleaned(column: str):
    """Units and brackets off, decimal point for comma, trimmed."""
    bare = F.regexp_replace(F.col(column), r"%|km/h|mph|RPM|rpm|\[|\]|\(|\)|\bA\b", "")
    return F.trim(F.replace(bare, F.lit(","), F.lit(".")))


def number(column: str):
    """The cleaned column as a number; what is none, or not a number, is NULL."""
    value = cleaned(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def _ordinal() -> Column:
    """Grows with the place of a row in its file: the split's first byte, then the rows of the task; wide enough for files of any size."""
    start = F.col("start").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)")
    return (start + F.pmod("place", F.lit(2**33))).cast("decimal(38,0)")


def _fields(line: Column, header: str) -> Column:
    """The fields of a line under this header that have canonical names, by these, as text; the line is parsed once. A quote inside quotes is doubled."""
    names = next(csv.reader([header]))
    chosen = mapping(names)
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    value = lambda row, c: row[f"c{names.index(chosen[c])}"] if c in chosen else F.lit(None).cast("string")
    parsed = F.transform(F.array(F.from_csv(line, F.lit(schema), {"escape": '"'})), lambda row: F.struct(*(value(row, c).alias(c) for c in VARIANTS)))
    return F.get(parsed, 0)


def _of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The lines with what files say of theirs: sent to all tasks if their paths are few bytes, else joined by path, where Spark splits those of a large file."""
    size = files.agg(F.coalesce(F.sum(F.octet_length("path") + 16), F.lit(0))).first()[0]
    return rows.join(F.broadcast(files) if size <= PATH_BYTES else files, "path")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Samples of all admitted files under canonical names with source_file and ordinal, and the manifest.

    The driver sees the different headers, not the files: each header is a kind, files
    carry the number of theirs, and one scan of all lines parses each by its kind. Blank
    lines and those that repeat the header are no samples. The manifest is written to a
    scratch folder, so it is made once.
    """
    place = scratch(spark)
    manifest(spark, folder).write.parquet(place)
    files = spark.read.parquet(place)
    admitted = files.filter("reject_reason IS NULL")
    kinds = sorted((r["header"], r["encoding"]) for r in admitted.select("header", "encoding").distinct().collect())
    columns = [(F.trim(F.col(f"s.{c}")) if c in TEXT_COLUMNS else number(f"s.{c}")).alias(c) for c in VARIANTS]
    if not kinds:
        schema = ", ".join(["source_file string", "ordinal decimal(38,0)", *(f"{c} {'string' if c in TEXT_COLUMNS else 'double'}" for c in VARIANTS)])
        return spark.createDataFrame([], schema), files
    numbered = spark.createDataFrame([(*kind, k) for k, kind in enumerate(kinds)], "header string, encoding string, kind int")
    of_file = admitted.join(F.broadcast(numbered), ["header", "encoding"]).select("path", "kind", "encoding")
    rows = _of_files(lines(spark, folder), of_file).withColumn("line", F.regexp_replace(_decoded(F.col("line"), F.col("encoding")), "^\ufeff", ""))
    header = F.get(F.array(*(F.lit(h) for h, _ in kinds)), F.col("kind"))
    rows = rows.filter(F.col("line").rlike(r"\S") & (F.col("line") != header))
    by_kind = F.coalesce(*(F.when(F.col("kind") == k, _fields(F.col("line"), h)) for k, (h, _) in enumerate(kinds)))
    return rows.select(F.col("path").alias("source_file"), _ordinal().alias("ordinal"), by_kind.alias("s")).select("source_file", "ordinal", *columns), files


def report(files: DataFrame, samples: DataFrame, trips: DataFrame) -> DataFrame:
    """Files found, processed and skipped, trips, success rate and trips per file, as one row."""
    counted = files.agg(F.count("*").alias("found"), F.count_if(F.col("reject_reason").isNull()).alias("processed"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"))
    made = trips.agg(F.count("*").alias("trips"))
    return counted.crossJoin(made).select("*", F.try_divide(F.col("processed") * 100.0, F.col("found")).alias("success_rate"), F.try_divide(F.col("trips"), F.col("processed")).alias("trips_per_file"))
