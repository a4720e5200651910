"""Gate, bucket and other preregistered configuration tables.

All are literals of a few rows, so broadcasting them is bounded by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values: (bucket, min size, max size, admitted identifiability classes).
BUCKETS = [
    ("small", 16, 64, ["identifiable"]),
    ("target", 128, 512, ["identifiable"]),
    ("all", 16, 512, ["identifiable", "equivalent_family"]),
]


def bucket_table(spark: SparkSession, buckets=BUCKETS) -> DataFrame:
    return spark.createDataFrame(
        buckets, "bucket string, min_size_px bigint, max_size_px bigint, identifiability_in array<string>"
    )


# Fixed values: (section, key, value, status).
GATES = [
    ("boundary", "p95_px", 0.25, "frozen"),
    ("boundary", "p99_px", 0.30, "frozen"),
    ("boundary", "max_px", 0.40, "frozen"),
    ("paint", "palette_delta", 8.0, "frozen"),
    ("delivery", "channel_delta", 6.0, "frozen"),
    ("runtime", "runtime_ms", 4500.0, "frozen"),
]


class GateError(ValueError):
    """A gate file that must not be used."""


def load_gates(spark: SparkSession, gates=GATES) -> DataFrame:
    """Gate table; a placeholder section or a non-finite value is refused."""
    for section, key, value, status in gates:
        if status != "frozen":
            raise GateError(f"section {section} is {status}, not frozen")
        if not math.isfinite(value):
            raise GateError(f"gate {section}.{key} is not finite")
    return spark.createDataFrame(gates, "section string, key string, gate double, status string")


def gate_findings(gates: DataFrame) -> DataFrame:
    """Row form of the same check, for gate tables read from files."""
    finite = ~F.isnan("gate") & (F.abs("gate") < float("inf"))
    problem = F.when(F.col("status") != "frozen", "placeholder_section").when(F.col("gate").isNull() | ~finite, "non_finite_value")
    return gates.select("section", "key", "gate", "status", problem.alias("refusal"))
