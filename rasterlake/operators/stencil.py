"""Neighbourhoods on dense pixel tables with one shuffle.

A raster may be far larger than a task, so it is cut into square tiles and each
pixel is copied into the tiles within ``halo`` pixels of it (about 6 % more rows
for a 64 px tile and a halo of one). After one hash partitioning by
(image, tile) every row and column of a tile is local: the horizontal and the
vertical windows only sort, they do not shuffle again. A chain of k stencils
needs a halo of k and still only that one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterlake.session import small_tasks

TILE = 64
TX, TY, CORE = "__tx", "__ty", "__core"
FOUR = ("e", "w", "s", "n")
EIGHT = (*FOUR, "se", "sw", "ne", "nw")


def tiled(px: DataFrame, keys: list[str], halo: int = 1, tile: int = TILE) -> DataFrame:
    """Copy pixels into tiles with a halo and partition by (keys, tile)."""

    def spans(c: str) -> Column:
        low = F.floor((F.col(c) - halo) / tile)
        return F.sequence(F.greatest(low, F.lit(0)), F.floor((F.col(c) + halo) / tile))

    small_tasks(px.sparkSession)
    d = px.withColumn(TY, F.explode(spans("y"))).withColumn(TX, F.explode(spans("x")))
    own = (F.col(TX) == F.floor(F.col("x") / tile)) & (F.col(TY) == F.floor(F.col("y") / tile))
    return d.withColumn(CORE, own).repartition(*keys, TY, TX)


def core(df: DataFrame) -> DataFrame:
    """Drop the halo copies again."""
    return df.filter(CORE).drop(TX, TY, CORE)


def row_window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, TY, TX, "y").orderBy("x")


def column_window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, TY, TX, "x").orderBy("y")


def around(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "", clamp: bool = True, diagonal: bool = True) -> DataFrame:
    """Add a struct of ``cols`` for each neighbour of a tiled table.

    The structs are named by direction after ``prefix``. A missing neighbour
    takes the own value (``clamp``) or NULL. Pixels may be absent from the table
    only without diagonals, which are reached through the pixel above or below.
    """
    wr, wc = row_window(keys), column_window(keys)
    own = F.struct(*cols)

    def side(fn, col: Column, axis: str, step: int, w) -> Column:
        there = fn(axis).over(w) == F.col(axis) + step
        return F.when(there, fn(col).over(w))

    fill = lambda v, o: F.coalesce(v, o) if clamp else v
    d = df.withColumn("__v", own)
    d = d.withColumns({"__w": side(F.lag, F.col("__v"), "x", -1, wr), "__e": side(F.lead, F.col("__v"), "x", 1, wr)})
    d = d.withColumns({"__w": fill(F.col("__w"), F.col("__v")), "__e": fill(F.col("__e"), F.col("__v"))})
    line = F.struct(F.col("__w").alias("w"), F.col("__v").alias("v"), F.col("__e").alias("e")) if diagonal else F.struct(F.col("__v").alias("v"))
    d = d.withColumn("__l", line)
    if diagonal:  # the line holds both sides: they are not sorted twice
        d = d.drop("__w", "__e")
    d = d.withColumns({"__n": side(F.lag, F.col("__l"), "y", -1, wc), "__s": side(F.lead, F.col("__l"), "y", 1, wc)})
    d = d.withColumns({"__n": fill(F.col("__n"), F.col("__l")), "__s": fill(F.col("__s"), F.col("__l"))})
    beside = (F.col("__l.w"), F.col("__l.e")) if diagonal else (F.col("__w"), F.col("__e"))
    out = {f"{prefix}w": beside[0], f"{prefix}e": beside[1], f"{prefix}n": F.col("__n.v"), f"{prefix}s": F.col("__s.v")}
    if diagonal:
        out |= {f"{prefix}{v}{h}": F.col(f"__{v}.{h}") for v in ("n", "s") for h in ("w", "e")}
    return d.withColumns(out).drop("__v", "__w", "__e", "__l", "__n", "__s")


def neighbours(px: DataFrame, keys: list[str], cols: list[str], clamp: bool = True, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """One stencil over a plain pixel table."""
    return core(around(tiled(px, keys, 1, tile), keys, cols, clamp=clamp, diagonal=diagonal))


def forget(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.drop(*[f"{prefix}{d}" for d in EIGHT])


def shifted(df: DataFrame, keys: list[str], col: str, offset: int, axis: str) -> Column:
    """Value ``offset`` pixels along an axis of a tiled table, NULL outside."""
    w = row_window(keys) if axis == "x" else column_window(keys)
    there = F.lead(axis, offset).over(w) == F.col(axis) + offset
    return F.when(there, F.lead(col, offset).over(w))


# ---- one bit per pixel ------------------------------------------------------

WORD, MARGIN = 48, 8  # core pixels of a word and copies of pixels on either side: 64 bits
INNER_BITS = ((1 << WORD) - 1) << MARGIN


def word_rows(px: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Pack flags into words: one row per (keys, y, word ``c``), bit i of a flag is pixel ``x = c * WORD + i``.

    Adds ``there`` for the pixels that are in the table. Words are combined before the shuffle, so a table whose raster
    rows lie together moves 1/48 of its rows.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(x, {WORD}) as int))")
    packed = [F.bit_or(F.when(v, bit).otherwise(F.lit(0).cast("bigint"))).alias(n) for n, v in flags.items()]
    return px.groupBy(*keys, "y", F.floor(F.col("x") / WORD).alias("c")).agg(*packed, F.bit_or(bit).alias("there"))


def with_margins(words: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Shift words up by ``MARGIN`` bits and fill both ends from the words beside them.

    The result is partitioned by (keys, c), so chains of up to ``MARGIN`` stencils over a column of words (at most as many
    rows as the raster) need no further exchange.
    """
    own = F.struct("c", *[F.shiftleft(F.col(n), MARGIN).alias(n) for n in cols])
    left = F.struct((F.col("c") - 1).alias("c"), *[F.shiftleft(F.col(n), WORD + MARGIN).alias(n) for n in cols])
    right = F.struct((F.col("c") + 1).alias("c"), *[F.shiftrightunsigned(F.col(n), WORD - MARGIN).alias(n) for n in cols])
    held = lambda e: F.greatest(*[e[n] != 0 for n in cols])
    sent = F.concat(F.array(own), F.filter(F.array(left, right), held))
    d = words.select(*keys, "y", F.explode(sent).alias("w")).select(*keys, "y", "w.*").repartition(*keys, "c")
    return d.groupBy(*keys, "c", "y").agg(*[F.bit_or(n).alias(n) for n in cols])


def word_above(col: str, keys: list[str], step: int) -> Column:
    """The word ``step`` raster rows below (1) or above (-1), 0 where there is none."""
    w = Window.partitionBy(*keys, "c").orderBy("y")
    fn = F.lead if step > 0 else F.lag
    return F.when(fn("y").over(w) == F.col("y") + step, fn(col).over(w)).otherwise(F.lit(0).cast("bigint"))


def west(v: Column) -> Column:
    return F.shiftleft(v, 1)


def east(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1)


def once_and_more(bits: list[Column]) -> tuple[Column, Column]:
    """Words of the places that at least one and at least two of ``bits`` hold."""
    if len(bits) == 1:
        return bits[0], F.lit(0).cast("bigint")
    (a, a2), (b, b2) = (once_and_more(h) for h in (bits[: len(bits) // 2], bits[len(bits) // 2 :]))
    return a.bitwiseOR(b), a2.bitwiseOR(b2).bitwiseOR(a.bitwiseAND(b))
