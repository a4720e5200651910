"""Exact duplicates by deterministic block naming.

The text without white space is cut into blocks. The distinct blocks are sorted and numbered, then adjacent numbers are
paired and the distinct pairs sorted and numbered, until one number is left of each document. Equal numbers mean equal
texts without any collision. The first block is short and carries the text's length: a document that is alone with its
length and first block has its identity at once, so only the others send their text through the sort.

Groups may be of any size: groups are only ever summed (with partial sums) and joined back, never gathered.

Defined cases: a null text equals an empty one; of equal texts the row with most code points stays, then the smallest
id (a null id comes last), then the first row read, so of repeated rows exactly one stays; an empty table gives an
empty result; further columns are not looked at and come back unchanged from ``drop_copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rasterlake.llm.bitmap import only_rows, without_rows
from rasterlake.llm.rows import numbered, sorted_names, unpack
from rasterlake.session import cut

HEAD = 64
BLOCK = 4096


def squeezed(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _identities(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """(row, first, rest): equal pairs mean equal texts, for rows whose first names are shared."""
    long = tied.filter(F.col("n") > HEAD)
    blocks = F.regexp_extract_all(F.substr("flat", F.lit(HEAD + 1)), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = only_rows(rows, long.select("row")).select("row", F.posexplode(blocks).alias("i", "block"))
    names = sorted_names(parts.select("block").distinct(), ["block"])
    level = cut(parts.join(names, "block").select("row", "i", "name"))
    most = long.agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(1, math.ceil((most - HEAD) / BLOCK))))):
        pairs = level.groupBy("row", F.floor(F.col("i") / 2).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = sorted_names(pairs.select("a", "b").distinct(), ["a", "b"])
        level = cut(pairs.join(names, ["a", "b"]).select("row", "i", "name"))
    whole = tied.join(level.select("row", F.col("name").alias("rest")), "row", "left")
    return whole.select("row", "first", F.coalesce("rest", F.lit(-1)).alias("rest"))


def _resolve(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, keep_id, keep_row, group_size, text_sha256) of every numbered row."""
    text = F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit(""))
    rows = base.select("row", squeezed(text).alias("flat"))
    facts = cut(
        base.select("row", F.col(f"doc.`{id_col}`").alias("doc_id"), F.length(text).alias("chars"), squeezed(text).alias("flat"))
        .select("row", "doc_id", "chars", F.length("flat").alias("n"), F.substring("flat", 1, HEAD).alias("head"), F.sha2("flat", 256).alias("text_sha256"))
    )
    shared = facts.groupBy("n", "head").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("n", "head")
    first = sorted_names(shared, ["n", "head"], "first")
    tied = cut(facts.join(first, ["n", "head"]).select("row", "doc_id", "chars", "n", "first"))
    same = cut(_identities(rows, tied))
    ranked = tied.select("row", F.struct("chars", (-F.col("doc_id")).alias("d"), (-F.col("row")).alias("r"), "doc_id", "row").alias("rank"))
    groups = same.join(ranked, "row").groupBy("first", "rest").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.filter("group_size > 1"))  # so that the join below may split a hot group
    found = same.join(groups, ["first", "rest"]).select(
        "row", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "group_size"
    )
    joined = facts.join(found, "row", "left")
    alone = F.col("keep_row").isNull()
    return joined.select(
        "row", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return _resolve(base, "doc_id", "text").drop("row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    base = numbered(docs)
    dropped = cut(_resolve(base, id_col, text_col).filter("not kept").select("row"))
    return unpack(without_rows(base, dropped))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS flat FROM documents
), g AS (
  SELECT flat, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -length(text), b := doc_id)) AS keep_id FROM t GROUP BY flat
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.flat) AS text_sha256 FROM t JOIN g USING (flat)
"""
