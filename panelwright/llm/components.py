"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component the smallest node reachable; nodes without links are left out.

    Every step maps a node's neighbours to its smallest one by an aggregate and an equality join, so a node with very
    many neighbours is pre-aggregated, and its join side can be split. The edges of each round are written to the
    shared folder. No links: no rows. Links of a node to itself and null ends are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while (now := _state(edges)) != before:
        if not now[0]:
            break
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    own = edges.groupBy("v").agg(F.first("v").alias("component")).select(F.col("v").alias("node"), "component")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)
