"""Connected components of an edge table, by alternating star contractions that only take minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import Tables

#: Tasks that one node's neighbours are dealt to.
SALTS = 256


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, component (the smallest node it is connected with) for every node of ``edges`` (a, b), a node's own included.

    Each round is a stored table, so lineage stays short, and drops that of the round before; the last is named edges in ``tables``.
    Rows of null ends and loops are left out.
    """
    tables = tables or Tables(edges.sparkSession, "components")
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs = tables.put("edges", pairs)
    mark = _mark(pairs)
    while True:
        pairs = tables.put("edges", _small_star(tables.put("large_star", _large_star(pairs))))
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    tables.drop("large_star")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u and m, the smallest v of each u; and ``pairs`` with it as a column. A node's pairs are dealt to many tasks, each taking its own smallest first."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    # A node has at most SALTS parts.
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    told = least.select("u", "m", F.explode("salts").alias("salt"))
    return least.select("u", "m"), salted.join(told, ["u", "salt"]).select("u", "v", "m")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest of its neighbourhood."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both)[1].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least, told = _least(pairs)
    moved = told.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
