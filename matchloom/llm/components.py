"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two joins on the node and a distinct, and is written to the shared scratch folder, so that lineage stays
short. Nothing is collected but a count and a checksum for each round. A node that a third of all others link to makes
one long join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.plans.scratch import materialise_counted


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every linked node; a component is named by its smallest node.

    Repeated links, links of a node to itself and links with nulls are ignored.
    """
    x, y = F.col(a), F.col(b)
    stored, seen = _store(links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while seen["n"]:
        both = stored.unionAll(stored.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following, now = _store(small.select("e.u", "e.v").filter("u != v").distinct())
        stored, same = following, now == seen
        seen = now
        if same:
            break
    return stored.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        stored.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _store(links: DataFrame) -> tuple[DataFrame, dict]:
    check = F.bit_xor(F.xxhash64("u", "v"))
    return materialise_counted(links, "links", n=F.count(F.lit(1)), check=F.coalesce(check, F.lit(0)))
