"""Row numbers that survive a recomputation, and sorted integer names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterlake.session import cut

#: the white space of the word and copy rules, as a character class
SPACE = r"\x20\x09-\x0D"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(docs: DataFrame) -> DataFrame:
    """(``row``, ``doc``): every row whole in one struct beside a stable number, in the shared folder.

    The struct keeps the input's column names apart from those of the operator.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), whole))


def unpack(rows: DataFrame) -> DataFrame:
    """The input's columns again."""
    return rows.select("doc.*")


def sorted_names(values: DataFrame, cols: list[str], name: str = "name") -> DataFrame:
    """Distinct ``values`` with integers in their sort order; written, so a name never changes.

    The order is that of a hash, then of the values themselves: ranges are then found from a sample of hashes, not of
    long values, and values that begin alike are spread.
    """
    keyed = values.withColumn("__h", F.xxhash64(*cols))
    ranged = keyed.repartitionByRange(partitions(values), "__h").sortWithinPartitions("__h", *cols)
    return cut(ranged.drop("__h").withColumn(name, F.monotonically_increasing_id()))
