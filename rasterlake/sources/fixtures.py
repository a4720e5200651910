"""Derived tables over the given Parquet tables.

Raster, chain, measurement and hypothesis tables that stand in for the data the
operators are written for. Every one is a projection, join or aggregation of
the given tables, so it grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rasterlake.operators.prefix import neighbour, ordered_index
from rasterlake.session import measured_joins, small_tasks


def _clamp01(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _whole(c):
    """Nearest whole number, of two the even one, as a cast to BIGINT has it in the SQL."""
    return F.rint(c).cast("bigint")


class Lake:
    """Tables of one data folder, with the derived tables as methods."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        measured_joins(spark)
        small_tasks(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- rasters -------------------------------------------------------
    def px8(self) -> DataFrame:
        """One 8x8 raster per embedding."""
        v = F.col("v").cast("double")
        return (
            self.table("embeddings")
            .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
            .select(
                "image_id",
                (F.col("pos") % 8).alias("x"),
                F.expr("cast(pos div 8 as int)").alias("y"),
                _clamp01((v + 0.6) / 1.2).alias("alpha"),
            )
            .withColumn("code", F.floor(F.col("alpha") * 255 + 0.5).cast("int"))
        )

    def px8s(self) -> DataFrame:
        """Contrast-stretched rasters."""
        a = _clamp01((F.col("alpha") - 0.5) * 6.0 + 0.5)
        return self.px8().withColumn("alpha", a).withColumn("code", F.floor(F.col("alpha") * 255 + 0.5).cast("int"))

    def rgba8(self) -> DataFrame:
        """RGBA rasters: four consecutive rasters become the four channels."""
        ch = F.col("image_id") % 4
        pick = lambda k: F.max(F.when(ch == k, F.col("code")))
        return (
            self.px8()
            .groupBy(F.expr("image_id div 4").alias("image_id"), "x", "y")
            .agg(
                pick(0).alias("r"),
                pick(1).alias("g"),
                pick(2).alias("b"),
                F.least(F.lit(255), pick(3) * 2).alias("a"),
            )
        )

    def flat32(self) -> DataFrame:
        """Posterised 32x32 rasters with flat 4x4 cells, some with an exterior."""
        img = F.col("image_id")
        up = F.explode(F.sequence(F.lit(0), F.lit(3)))
        level = lambda c, hi, lo, on: F.when(on & (F.col(c) > 127), hi).otherwise(lo)
        alpha = F.when(img % 2 == 0, 255).when(F.col("a") < 200, 0).when(img % 4 == 1, 255).otherwise(128)
        return (
            self.rgba8()
            .withColumn("i", up)
            .withColumn("j", up)
            .select(
                "image_id",
                (F.col("x") * 4 + F.col("i")).alias("x"),
                (F.col("y") * 4 + F.col("j")).alias("y"),
                level("r", 200, 40, F.lit(True)).alias("r"),
                level("g", 190, 60, img % 3 > 0).alias("g"),
                level("b", 220, 30, img % 3 == 2).alias("b"),
                alpha.alias("a"),
            )
        )

    def mosaic(self) -> DataFrame:
        """All rasters of a label tiled eight per row."""
        slots = ordered_index(
            self.table("embeddings").select("label", F.col("vec_id").alias("image_id")), ["label"], ["image_id"], "slot"
        )
        return (
            self.px8()
            .join(slots, "image_id")
            .select(
                "label",
                (F.col("slot") % 8 * 8 + F.col("x")).cast("int").alias("x"),
                (F.expr("slot div 8") * 8 + F.col("y")).cast("int").alias("y"),
                "alpha",
            )
        )

    def grid(self) -> DataFrame:
        """A dense 64x64 raster per supplier."""
        line = self.table("lineitem")
        cells = line.groupBy(
            F.col("l_suppkey").alias("image_id"),
            (F.col("l_partkey") % 64).cast("int").alias("x"),
            (F.col("l_orderkey") % 64).cast("int").alias("y"),
        ).agg((F.sum(_whole(F.col("l_discount") * 100)) / (F.lit(10.0) * F.count("*"))).alias("v"))
        # only cells move: a raster row gets its few cells as one map and is spread to pixels where it lies
        cells = cells.filter("x >= 0").groupBy("image_id", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
        rows = line.select(F.col("l_suppkey").alias("image_id")).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(63))))
        d = rows.join(cells, ["image_id", "y"], "left").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(63))))
        return d.select("image_id", "x", "y", F.coalesce(_clamp01(F.try_element_at("m", F.col("x"))), F.lit(0.0)).alias("v"))

    def wide(self) -> DataFrame:
        """Four rasters of 256x208: flat cells of 8x8 with a slight texture, so regions and stencils cross tiles."""
        line = self.table("lineitem")
        cells = line.groupBy((F.col("l_suppkey") % 4).alias("image_id"), (F.col("l_partkey") % 32).alias("cx"), (F.col("l_orderkey") % 26).alias("cy")).agg(
            (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) % 11 / F.lit(10.0)).alias("v")
        )
        every = line.select((F.col("l_suppkey") % 4).alias("image_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(256 * 208 - 1))))
        dots = every.select("image_id", (F.col("k") % 256).alias("x"), F.expr("cast(k div 256 as int)").alias("y"))
        dots = dots.withColumns({"cx": F.expr("cast(x div 8 as bigint)"), "cy": F.expr("cast(y div 8 as bigint)")})
        v = _clamp01(F.coalesce("v", F.lit(0.0)) + (F.col("x") * 7 + F.col("y") * 13) % 5 * 0.002)
        return dots.join(cells, ["image_id", "cx", "cy"], "left").select("image_id", "x", "y", v.alias("v"))

    def labels4(self) -> DataFrame:
        lab = F.least(F.lit(3), F.floor(F.col("alpha") * 4).cast("int"))
        return self.px8().select("image_id", "x", "y", lab.alias("label"))

    def bin8(self) -> DataFrame:
        return self.px8s().select("image_id", "x", "y", (F.col("alpha") >= 0.5).alias("inside"))

    def pair(self) -> DataFrame:
        """Observed raster next to the following one as its prediction."""
        a = self.px8().select("image_id", "x", "y", F.col("alpha").alias("obs"))
        b = self.px8().select((F.col("image_id") - 1).alias("image_id"), "x", "y", F.col("alpha").alias("pred"))
        return a.join(b, ["image_id", "x", "y"])

    # ---- chains --------------------------------------------------------
    @cached_property
    def _chain(self) -> DataFrame:
        rows = self.table("events").select(F.col("user_id").alias("chain_id"), "ts", "event_id", "value")
        return ordered_index(rows, ["chain_id"], ["ts", "event_id"], "k").select(
            "chain_id",
            "k",
            (F.col("value") / 10).alias("px"),
            F.col("k").cast("double").alias("py"),
            F.lit(0.35).alias("halfwidth"),
            F.lit(1.0).alias("weight_ds"),
        )

    def chain(self) -> DataFrame:
        return self._chain

    def segments(self) -> DataFrame:
        c = neighbour(self.chain(), ["chain_id"], "k", ["px", "py"], 1, "_n")
        return c.filter(F.col("px_n").isNotNull()).select(
            "chain_id",
            F.col("k").alias("sid"),
            F.col("px").alias("x1"),
            F.col("py").alias("y1"),
            F.col("px_n").alias("x2"),
            F.col("py_n").alias("y2"),
        )

    # ---- measurements --------------------------------------------------
    def _orders_customers(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        return o.join(c, o.o_custkey == c.c_custkey)

    def samples(self) -> DataFrame:
        line = self.table("lineitem")
        return line.join(self._orders_customers(), line.l_orderkey == F.col("o_orderkey")).select(
            F.col("l_returnflag").alias("axis_flag"),
            F.col("l_linestatus").alias("axis_status"),
            F.col("l_linenumber").alias("axis_line"),
            F.col("c_mktsegment").alias("axis_segment"),
            (F.col("l_discount") * 10).alias("distance_px"),
            (F.col("l_tax") * 10).alias("sigma_px"),
            F.col("l_quantity").alias("weight_ds"),
            F.col("l_tax").alias("bias_px"),
            (F.col("l_tax") >= 0.08).alias("capped"),
        )

    def meas(self) -> DataFrame:
        """Measurement rows; (group, scene, cell) is not unique."""
        line = self.table("lineitem")
        p = F.col("l_partkey")
        worst = F.col("l_discount") * 3 + F.col("l_tax") + F.col("l_tax")
        within = lambda gate: F.floor((p % 90 + 10) * F.least(F.lit(1.0), F.lit(gate) / F.greatest(worst, F.lit(1e-9))))
        return line.join(self._orders_customers(), line.l_orderkey == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("group_id"),
            F.col("l_suppkey").alias("scene_id"),
            F.col("l_linenumber").cast("bigint").alias("cell_id"),
            F.col("c_mktsegment").alias("family"),
            F.expr("cast(16 * shiftleft(1, cast(l_partkey % 6 as int)) as bigint)").alias("size_px"),
            F.col("l_returnflag").alias("profile"),
            F.when(p % 5 == 4, "equivalent_family").otherwise("identifiable").alias("identifiability"),
            (F.col("l_linestatus") == "O").alias("accepted"),
            ((F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07)).alias("catastrophic"),
            (F.col("l_linenumber") <= 4).alias("mandatory"),
            _whole(F.col("l_quantity") * 100).alias("runtime_ms"),
            (F.col("l_discount") * 3).alias("p95_px"),
            (F.col("l_discount") * 3 + F.col("l_tax")).alias("p99_px"),
            (F.col("l_discount") * 3 + F.col("l_tax") + F.col("l_tax")).alias("max_px"),
            (p % 90 + 10).alias("samples"),
            within(0.35).alias("at95"),
            within(0.45).alias("at99"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 997).alias("bits_per_block"),
            F.col("o_orderpriority").alias("class"),
            F.col("o_orderstatus").alias("status"),
            F.when(p % 7 != 0, F.concat(F.lit("reason_"), p % 4)).alias("reason"),
            _whole(F.col("l_discount") * 100).alias("palette_delta"),
            _whole(F.col("l_tax") * 100).alias("channel_delta"),
            _whole("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            "l_orderkey",
            "l_partkey",
            "l_shipdate",
        )

    def meas1(self) -> DataFrame:
        """Measurement rows merged to one per (group, scene, cell)."""
        return (
            self.meas()
            .groupBy("group_id", "scene_id", "cell_id")
            .agg(
                F.first("family").alias("family"),
                F.max("size_px").alias("size_px"),
                F.min("profile").alias("profile"),
                F.min("identifiability").alias("identifiability"),
                F.bool_and("accepted").alias("accepted"),
                F.bool_or("catastrophic").alias("catastrophic"),
                F.bool_and("mandatory").alias("mandatory"),
                F.max("runtime_ms").alias("runtime_ms"),
                F.max("p95_px").alias("p95_px"),
                F.max("p99_px").alias("p99_px"),
                F.max("max_px").alias("max_px"),
                F.max("samples").alias("samples"),
                F.max("bits_per_block").alias("bits_per_block"),
                F.max("palette_delta").alias("palette_delta"),
                F.max("channel_delta").alias("channel_delta"),
                F.max("quantity").alias("quantity"),
                F.first("class").alias("class"),
                F.first("status").alias("status"),
                F.max("reason").alias("reason"),
            )
        )

    # ---- hypotheses, arms, runs ----------------------------------------
    def hyp(self) -> DataFrame:
        cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            F.concat_ws(
                "-",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                cents("l_extendedprice"),
                _whole("l_quantity"),
                cents("l_discount"),
                cents("l_tax"),
                "l_returnflag",
                F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("hypothesis_id"),
            F.concat(F.lit("d"), F.col("l_partkey") % 5).alias("delivery"),
            F.col("l_returnflag").alias("topology_class"),
            F.col("l_linestatus").alias("formation_class"),
            (F.col("l_extendedprice") / 1000).alias("total_bits"),
            _whole("l_quantity").alias("memory_bytes"),
        )

    def arms(self) -> DataFrame:
        e = F.col("event_type")
        return self.table("events").select(
            "user_id",
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            F.when(e == "click", "PF00")
            .when(e == "view", "PF01")
            .when(e == "purchase", "PF10")
            .when(e == "signup", "PF11")
            .alias("arm"),
            (e == "error").alias("contaminated"),
            "value",
            "event_id",
            F.concat(F.lit("b"), F.col("user_id") % 3).alias("backend"),
            F.concat(F.lit("c"), F.col("event_id") % 2).alias("config"),
        )

    def runs(self) -> DataFrame:
        return (
            self.table("documents")
            .groupBy(
                F.col("source").alias("input"), F.col("lang").alias("artifact"), (F.col("doc_id") % 3).alias("repeat")
            )
            .agg(F.min(F.sha2("text", 256)).alias("own"))
            .withColumn("cell", F.min("own").over(Window.partitionBy("input", "artifact")))  # three rows of a cell
            # in half of the cells all repeats have the cell's first text, in the others their own
            .select("input", "artifact", "repeat", F.when((F.length("input") + F.ascii("artifact")) % 2 == 0, F.col("cell")).otherwise(F.col("own")).alias("digest"))
        )

    def manifest(self) -> DataFrame:
        return self.table("pages").select(
            F.concat(F.lit("page-"), "page_id").alias("name"),
            F.sha2("html", 256).alias("sha256"),
            (F.length("url") + 16).cast("bigint").alias("width"),
            (F.length("html") % 512 + 1).cast("bigint").alias("height"),
        )

    def files(self) -> DataFrame:
        p = F.col("page_id")
        pages = self.table("pages")
        kept = pages.filter(p % 7 != 0).select(
            F.concat(F.lit("page-"), "page_id").alias("name"),
            F.sha2(F.when(p % 11 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("sha256"),
            F.when(p % 13 != 0, (F.length("url") + 16).cast("bigint")).alias("width"),
            F.when(p % 17 == 0, F.lit(0).cast("bigint"))
            .otherwise((F.length("html") % 512 + 1).cast("bigint"))
            .alias("height"),
        )
        one = F.lit(1).cast("bigint")
        extra = pages.filter(p % 10 == 0).select(
            F.concat(F.lit("extra-"), "page_id").alias("name"), F.sha2("url", 256).alias("sha256"), one.alias("width"), one.alias("height")
        )
        return kept.unionByName(extra)

    def changes(self) -> DataFrame:
        gate = F.col("role") == "user"
        return self.table("conversations").select(
            F.col("conv_id").alias("change_set"),
            F.concat(
                F.when(gate, "configs\\gate_").otherwise("crates/code_"),
                (F.col("turn") % 3).cast("string"),
                F.when(gate, ".toml").otherwise(".src"),
            ).alias("path"),
            F.element_at(F.array(F.lit("A"), F.lit("M"), F.lit("D")), (F.length("text") % 3 + 1).cast("int")).alias("kind"),
            ((F.col("conv_id") % 2 == 0) & (F.col("turn") < 2)).alias("at_base"),
            "turn",
        )


class WideLake(Lake):
    """The same tables with the wide rasters in place of the small ones."""

    def grid(self) -> DataFrame:
        return self.wide()

    def px8(self) -> DataFrame:
        a = F.col("v")
        return self.wide().select("image_id", "x", "y", a.alias("alpha"), F.floor(a * 255 + 0.5).cast("int").alias("code"))
