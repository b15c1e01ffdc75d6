"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is a grouped minimum and a join, so a node with very many neighbours is pre-aggregated before it is
shuffled and no neighbour list is ever collected. In the joins the hot keys, at most MOST_HOT by their
number of rows, are broadcast and never shuffled; where there are no more keys than that, all are. Each half of a round is
written to the shared folder, so its plan stays small, and the round before is deleted. Rounds end when the edges are
stars, which one aggregation tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, stored

HOT_ROWS, MOST_HOT = 1_000, 100_000


def join_on_hot_keys(rows: DataFrame, by_key: DataFrame, key: str, n_rows: int, n_keys: int | None = None) -> DataFrame:
    """rows joined with by_key (key, n, ...), which says how many rows each key has; n is dropped.

    A key is hot from HOT_ROWS rows on, and from so many that not more than MOST_HOT keys can be: these are broadcast,
    the rows of the others meet their key in a shuffled join. Of n_keys keys, if known to be no more than MOST_HOT, all are
    broadcast.
    """
    more = [c for c in by_key.columns if c not in (key, "n")]
    if n_keys is not None and n_keys <= MOST_HOT:
        return rows.join(F.broadcast(by_key.drop("n")), key).select(*rows.columns, *more)
    least = max(HOT_ROWS, -(-n_rows // MOST_HOT))
    hot = by_key.filter(F.col("n") >= least).select(key, *[F.col(c).alias(f"_hot_{c}") for c in more], F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    straight = marked.filter("_hot").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in more])
    return marked.filter("_hot IS NULL").select(rows.columns).join(by_key.filter(F.col("n") < least).drop("n"), key).select(straight.columns).union(straight)


def _shape(e: DataFrame) -> tuple[int, int, bool]:
    """Nodes and edges of distinct edges (u, v), u > v, and whether they are anything but stars around their smallest node."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = nodes.agg(F.count("*"), F.sum("up"), F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return found[0], found[1] or 0, bool(found[2])


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, root): the smallest identifier of the component, for every identifier in an edge.

    Direction, repeated edges and loops don't matter; an identifier only in a loop is its own root.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    first = stored(ends.distinct())
    loops = first.filter("u = v").select(F.col("u").alias("id"))
    e, last = first.filter("u > v"), None
    while True:
        nodes, size, tangled = _shape(e)
        if not tangled:
            break
        with passing(spark) as made:
            both = e.union(e.select("v", "u").toDF("u", "v"))
            low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            large = join_on_hot_keys(both.filter("v > u"), low, "u", 2 * size, nodes).select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = stored(large)  # v > u >= m, and no more edges than before
            low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = join_on_hot_keys(down, low, "u", size, nodes).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
            e = stored(small.filter("u != v").distinct())
            new = made.pop()
            made += [last] if last else []
            last = new
    own = e.select(F.col("v").alias("id"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(own).union(loops.select("id", F.col("id").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))
