"""Image scans, ingest limits, manifests, inventories, journals and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rasterlake.operators.digests import ordered_digest

# What may be decoded at all.
@dataclass(frozen=True)
class DecodeLimits:
    max_dimension_px: int = 8192
    max_pixels: int = 32_000_000
    max_encoded_bytes: int = 64 * 1024 * 1024


# ---- S-1 ---------------------------------------------------------------


def scan_images(spark: SparkSession, path: str, limits: DecodeLimits | None = None) -> DataFrame:
    """Pixel table of a folder of images, decoded by Spark's image source.

    The decoder stores rows of BGR or BGRA bytes. One row per scanline is made
    first, so no array is longer than the image is wide. An image that cannot be
    decoded or is over the limits is one row without pixel, with a ``refusal``.
    """
    img = spark.read.format("image").load(path).select("image.*")
    broken = F.col("height").isNull() | (F.col("height") < 0)
    undecodable = F.struct(F.lit("undecodable").alias("kind"), F.lit("no pixels").alias("detail"))
    over = ingest_refusal(limits or DecodeLimits(), F.col("width"), F.col("height"), F.length("data"))
    img = img.withColumn("refusal", F.when(broken, undecodable).otherwise(over))
    ch, stride = F.col("nChannels"), F.col("width") * F.col("nChannels")
    lines = img.filter("refusal is null").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).select(
        F.col("origin").alias("image_id"), "width", "y", ch.alias("n"), F.substring("data", F.col("y") * stride + 1, stride).alias("line"), "refusal",
    )
    px = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def byte(i: int) -> Column:  # a slice of a BINARY, wherever it lies in the line, costs the same
        return F.conv(F.hex(F.substring("line", F.col("x") * F.col("n") + i + 1, F.lit(1))), 16, 10).cast("int")

    pick = lambda k: F.when(F.col("n") == 1, byte(0)).otherwise(byte(k))
    alpha = F.when(F.col("n") == 4, byte(3)).otherwise(F.lit(255))
    pixels = px.select("image_id", "x", "y", pick(2).alias("r"), pick(1).alias("g"), pick(0).alias("b"), alpha.alias("a"), "refusal")
    none = [F.lit(None).cast("int").alias(c) for c in ("x", "y", "r", "g", "b", "a")]
    return pixels.unionByName(img.filter("refusal is not null").select(F.col("origin").alias("image_id"), *none, "refusal"))


def pixels_from_array(rows: DataFrame, image_id: str, values: str, width: int) -> DataFrame:
    """Pixel table of a row-major array column."""
    d = rows.select(F.col(image_id).alias("image_id"), F.posexplode(values).alias("pos", "v"))
    return d.select("image_id", (F.col("pos") % width).alias("x"), F.expr(f"cast(pos div {width} as int)").alias("y"), "v")


# ---- S-2 ---------------------------------------------------------------


def ingest_refusal(limits: DecodeLimits, width: Column, height: Column, encoded: Column) -> Column:
    """Typed refusal STRUCT<kind, detail>, NULL when the image may be decoded."""
    say = lambda kind, fmt, *cols: F.struct(F.lit(kind).alias("kind"), F.format_string(fmt, *cols).alias("detail"))
    return (
        F.when(encoded > limits.max_encoded_bytes, say("encoded_too_large", f"%s bytes over {limits.max_encoded_bytes}", encoded))
        .when((width == 0) | (height == 0), say("empty", "%sx%s", width, height))
        .when(
            (width > limits.max_dimension_px) | (height > limits.max_dimension_px),
            say("dimension_too_large", f"%sx%s over {limits.max_dimension_px}", width, height),
        )
        .when(width * height > limits.max_pixels, say("too_many_pixels", f"%s pixels over {limits.max_pixels}", width * height))
    )


# ---- S-3 ---------------------------------------------------------------


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every declared or present file."""
    m = manifest.select("name", F.col("sha256").alias("m_sha"), F.col("width").alias("m_w"), F.col("height").alias("m_h"))
    d = m.join(files, "name", "full")
    status = (
        F.when(F.col("m_sha").isNull(), "not_in_manifest")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.col("width").isNull() | F.col("height").isNull(), "invalid")
        .when((F.col("width") != F.col("m_w")) | (F.col("height") != F.col("m_h")), "dimension_mismatch")
        .when(F.col("sha256") != F.col("m_sha"), "hash_mismatch")
        .otherwise("ok")
    )
    return d.select("name", status.alias("status"))


# ---- S-4 ---------------------------------------------------------------

JOURNAL_SCHEMA = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("report_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("payload", T.DoubleType()),
    ]
)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSONL journal."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_journal(lines: DataFrame, expected_header: str) -> DataFrame:
    """Row records of a journal, each with a ``refusal`` when its header differs.

    Records are tagged ``Header`` or ``Row``. The distinct headers are few (one
    per report), so they are matched by a join on the report.
    """
    rec = lines.select(F.from_json("line", JOURNAL_SCHEMA).alias("r"), "line").select("r.*", "line")
    heads = (
        rec.filter(F.col("tag") == "Header")
        .groupBy("report_id")
        .agg(F.min("key").alias("__lo"), F.max("key").alias("__hi"), F.count("*").alias("__n"))
    )
    rows = rec.filter(F.col("tag") == "Row").join(heads, "report_id", "left")
    refusal = (
        F.when(F.col("__n").isNull(), "no_header")
        .when((F.col("__lo") != expected_header) | (F.col("__hi") != expected_header), "header_mismatch")
    )
    return rows.select("report_id", "key", "payload", refusal.alias("refusal"))


# ---- S-5 ---------------------------------------------------------------


def canonical_lines(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One JSON text per row with fields in name order."""
    return rows.select(*keys, F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("line"))


def report_digest(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Content digest of each report over its canonically ordered lines."""
    keep = list(dict.fromkeys([*by, *order]))
    return ordered_digest(canonical_lines(rows, keep, columns), by, order, F.col("line"))


def write_report(rows: DataFrame, path: str, partitions: list[str], order: list[str]) -> None:
    """Bulk sink: Parquet by partition columns, files sorted by ``order``."""
    (
        rows.repartition(*partitions, F.pmod(F.xxhash64(*order), F.lit(64)))
        .sortWithinPartitions(*partitions, *order)
        .write.mode("overwrite")
        .partitionBy(*partitions)
        .parquet(path)
    )


# ---- S-6 ---------------------------------------------------------------


def artifact_inventory(spark: SparkSession, path: str, declared: list[str]) -> DataFrame:
    """Recursive listing: name below the folder, size, digest, whether the file was declared.

    A file over the source's own limit for one value is listed with the refusal
    ``too_large`` and no digest; its content is not read.
    """
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split(":", 1)[-1].strip("/")
    name = F.expr(f"ltrim('/', substring(path, instr(path, '{root}') + {len(root)}))")
    fits = F.col("length") <= most
    small = files.filter(fits).select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("refusal"))
    large = files.filter(~fits).select(name.alias("name"), "length", F.lit(None).cast("string").alias("sha256"), F.lit("too_large").alias("refusal"))
    return small.unionByName(large).withColumn("declared", F.col("name").isin(*declared))
