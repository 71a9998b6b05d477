"""Connected components of an edge table, distributed and restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_row_number
from .storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component of every node of ``edges``; a component is named by its least node.

    Large-star and small-star steps alternate until nothing changes, about log(longest path) rounds. Each
    star step hangs a node's neighbours on the least of them and no node ever gathers its neighbours in one
    row. Each round is written to the shared folder. Null ends and loops are ignored.
    """
    links = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"), "component-edges")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v"))
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        down = large.union(own).where("u <> v").distinct()
        center = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(center, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.union(center.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if now == state and now[0] == now[2]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    rest = nodes.distinct().join(found, "node", "left")
    return rest.select("node", F.coalesce("component", "node").alias("component"))


def component_ids(nodes: DataFrame, edges: DataFrame, node: str, prefix: str = "ent_", width: int = 6, a: str = "a", b: str = "b") -> DataFrame:
    """Every node with a dense id of its component, numbered by least node; edges with unknown ends are ignored."""
    known = nodes.select(node).distinct()
    inside = edges.join(known.select(F.col(node).alias(a)), a, "left_semi").join(known.select(F.col(node).alias(b)), b, "left_semi")
    parts = connected_components(inside, a, b)
    full = known.join(parts, known[node] == parts["node"], "left").select(known[node], F.coalesce("component", known[node]).alias("__root"))
    roots = materialize(full.select("__root").distinct(), "roots")
    named = global_row_number(roots, ["__root"], "__n").select("__root", F.format_string(f"{prefix}%0{width}d", "__n").alias("entity_id"))
    return full.join(named, "__root").select(node, "entity_id")
