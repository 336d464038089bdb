"""Connected components of a table of links, by contraction: no group, list or table of nodes ever meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._shared import lookup, release, settle, steps


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), nulls and loops left out; root is the least node of the component.

    Each round every root points to its least neighbour, pointers are halved until they are stars, and the links
    between stars, without repeats, are the next round's. Rounds and halvings grow with the logarithm of the input.
    """
    with steps() as kept:
        links = settle(edges.select("a", "b").filter("a <> b").distinct())
        found: list[DataFrame] = []
        while links.head(1):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
            while True:
                over = up.select(F.col("node").alias("root"), F.col("root").alias("next")).filter("root <> next")
                nearer = settle(lookup(up, over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
                moved = bool(nearer.filter("moved").head(1))
                release(up)
                up = nearer
                if not moved:
                    break
            found.append(up)
            up = up.select("node", "root")
            a = lookup(links, up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            a = settle(a.select("ra", "b"))
            b = lookup(a, up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            links = settle(b.select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not found:
            kept.append(links)
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        out = found[0]
        for up in found[1:]:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            out = settle(lookup(out.select("node", "root"), step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        kept.append(out)
        return out.select("node", "root")
