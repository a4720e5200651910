"""Resumable measurement journal as Structured Streaming jobs.

Every job writes one folder per micro-batch and overwrites it on a retry, so a
replayed batch changes nothing. All folders lie under the shared checkpoint
folder unless the caller names others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from rasterlake.operators.reliability import RiskTarget, certificate, confidence_guard, scored
from rasterlake.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)


def arrive(rows: DataFrame, folder: str, part: int) -> None:
    """Put rows into the folder of a stream."""
    rows.write.mode("overwrite").parquet(f"{folder}/part-{part}")


def run_available(stream: DataFrame, sink, state_folder: str, mode: str = "append") -> None:
    """Process everything that is available now, then stop."""
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state_folder)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All batches written so far; ``batch`` is the partition column."""
    return spark.read.schema(schema.add("batch", T.LongType())).parquet(folder)


def ingest(stream: DataFrame, store: str, state: str) -> None:
    """Exactly-once rows by key from (key, payload, at, id).

    The first row of a key is kept: that of the earliest batch, and in it of the least (at, id). A later identical row is
    ignored, a later different one goes to quarantine. The stream counts rows by key and payload, so a batch reads and
    writes the state of its own keys only, however long the journal is, and its folder holds what it changed; what is
    first and what conflicts is read off these folders. A batch that runs again writes its own folder again.
    """
    counts = stream.groupBy("key", "payload").agg(F.count("*").alias("n"), F.min(F.struct("at", "id")).alias("first"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    run_available(counts, sink, state, "update")


def _journal(spark: SparkSession, store: str) -> DataFrame:
    """(key, payload, n, first, batch): rows of a payload so far, after each batch that brought some."""
    return spark.read.option("basePath", store).parquet(f"{store}/batch=*").withColumn("batch", F.col("batch").cast("long"))


def _truth(rows: DataFrame) -> DataFrame:
    """(key, truth): the first payload of every key and its batch; a payload is in its first batch at its own first row."""
    order = F.struct("batch", "first.at", "first.id", "payload")
    return rows.groupBy("key").agg(F.min_by(F.struct("payload", "batch"), order).alias("truth"))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(key, payload, batch) of every key."""
    return _truth(_journal(spark, store)).select("key", "truth.payload", "truth.batch")


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    """(key, payload, batch), one row for each conflicting row."""
    rows = _journal(spark, store)
    w = Window.partitionBy("key", "payload").orderBy("batch")  # one row per batch
    new = rows.select("key", "payload", "batch", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("n"))
    bad = new.join(_truth(rows), "key").filter(~F.col("payload").eqNullSafe(F.col("truth.payload")))
    return bad.select("key", "payload", "batch", F.explode(F.expr("sequence(1L, n)"))).select("key", "payload", "batch")


def running_verdicts(stream: DataFrame, out: str, state: str, target: RiskTarget = RiskTarget()) -> None:
    """Group verdict flags kept as streaming state; only changed groups are
    written per batch (update mode)."""
    must = F.col("mandatory")
    flags = (
        stream.filter(F.col("profile") != target.contaminated_profile)
        .groupBy("group_id")
        .agg(
            F.max(must.cast("int")).alias("seen"),
            F.max((must & F.col("accepted")).cast("int")).alias("accepted"),
            F.max((must & F.col("accepted") & F.col("catastrophic")).cast("int")).alias("catastrophic"),
        )
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(flags, sink, state, "update")


def latest_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """Latest verdict of every group that was seen."""
    fields = [T.StructField(n, t) for n, t in (("group_id", T.LongType()), ("seen", T.IntegerType()), ("accepted", T.IntegerType()), ("catastrophic", T.IntegerType()))]
    d = read_batches(spark, out, T.StructType(fields))
    last = d.groupBy("group_id").agg(F.max_by(F.struct("seen", "accepted", "catastrophic"), "batch").alias("l")).select("group_id", "l.*")
    verdict = F.when(F.col("catastrophic") == 1, "accepted_catastrophic").when(F.col("accepted") == 1, "accepted_clean").otherwise("abstained")
    return last.filter("seen = 1").select("group_id", verdict.alias("verdict"))


COUNTS = ("groups_total", "groups_accepted", "groups_catastrophic", "renders_total", "renders_accepted")


FLAGS = "group_id long, groups_total long, groups_accepted long, groups_catastrophic long, renders_total long, renders_accepted long, mark boolean"


def running_certificate(stream: DataFrame, out: str, state: str, target: RiskTarget = RiskTarget()) -> None:
    """What is known of the groups that a batch holds, after that batch.

    The flags of a group are state of the stream; a batch reads, changes and writes those of its own groups, and one row
    with ``mark`` says that it ran.
    """
    must, accepted, bad = (F.coalesce(c, F.lit(False)) for c in ("mandatory", "accepted", "catastrophic"))
    flag = lambda c: F.max(c.cast("long"))
    known = scored(stream, target).groupBy(F.col("group_id").cast("long").alias("group_id")).agg(
        flag(must).alias("groups_total"), flag(must & accepted).alias("groups_accepted"), flag(must & accepted & bad).alias("groups_catastrophic"),
        F.count("*").alias("renders_total"), F.count_if(accepted).alias("renders_accepted"),
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        zeros = [F.lit(None).cast("long").alias("group_id"), *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(True).alias("mark")]
        ran = batch.sparkSession.range(1).select(*zeros)
        batch.withColumn("mark", F.lit(False)).unionByName(ran).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(known, sink, state, "update")


def certificates(spark: SparkSession, out: str, model: Column, calibrated: Column, target: RiskTarget = RiskTarget()) -> DataFrame:
    """The certificate after every batch, with its exact bound."""
    rows = read_batches(spark, out, T.StructType.fromDDL(FLAGS))
    w = Window.partitionBy("mark", "group_id", F.when(F.col("mark"), F.col("batch"))).orderBy("batch")  # a row per batch
    changes = rows.select("batch", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in COUNTS])
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    sums = changes.groupBy("batch").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return certificate(sums.select("batch", *[F.sum(c).over(upto).alias(c) for c in COUNTS]), target, confidence_guard(model, calibrated))


def progress(expected: DataFrame, store: DataFrame) -> DataFrame:
    """Expected keys that have not been stored yet."""
    return expected.join(store.select("key"), "key", "left_anti")
