"""Connected components of a large, skewed graph by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_limit, join_one_row_per_key, materialize


def _star(edges: DataFrame, hot_above: int) -> DataFrame:
    """Link each neighbour of ``u`` to the smallest node of u's neighbourhood."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return join_one_row_per_key(edges, least, ["u"], "n", hot_above, "v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b).

    ``root`` is the smallest node of the component. Alternates large-star and
    small-star steps (Kiveris et al., 2014) until the edges stay the same, which
    takes a number of rounds that is logarithmic in the size of a component.
    Each round is written to the shared folder. A hub's neighbours are dealt
    out, so a component may hold any share of the nodes. Self-loops and null
    ends are ignored.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    hot = hot_limit(2 * seen[0])
    while seen != state:
        state = seen
        both = now.union(now.select("v", "u"))
        large = _star(both, hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, hot)
        now = materialize(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct(), "edges")
        seen = mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
