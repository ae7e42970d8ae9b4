"""Connected components of links that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import discard, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u, v) links of long ids to (node, root): root is the smallest id that node reaches; nodes are those with links.

    Alternates large and small stars: each node's larger, then its smaller neighbours are hung on its least
    neighbour. All steps are aggregations and joins by node. The least neighbour is found with partial
    aggregates, stored and then joined back: both sides of the join are plain exchanges then, and Spark splits a
    node with very many links. Rounds grow with the logarithm of the longest chain; each is written to the
    shared folder. Repeated links count once, links of a node to itself not at all; no links give no rows.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    state = _state(links)
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        above = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(above, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = stored(large, "stars")
        least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(links, above, down, least)
        links, now = new, _state(new)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
