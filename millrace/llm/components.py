"""Connected components over a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp: the smallest node that each node of edges (a, b) reaches.

    Each round, every node hooks onto the smallest label around it and labels are shortened by one jump, so the rounds are
    about the logarithm of the longest path. Every round is written, so none is computed again.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    total = labels.agg(F.sum("comp").alias("s")).first()["s"]
    while total is not None:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        # A root also takes the smallest label that any node of its tree sees.
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("near", "comp").alias("low"))
        roots = seen.groupBy("comp").agg(F.min("low").alias("low")).select(F.col("comp").alias("root"), "low")
        new = scratch.keep(seen.alias("s").join(roots.alias("r"), F.col("s.comp") == F.col("r.root")).select("s.node", F.col("r.low").alias("comp")))
        up = new.select(F.col("node").alias("root"), F.col("comp").alias("top"))
        jumped = scratch.keep(new.join(up, new["comp"] == up["root"], "left").select("node", F.coalesce("top", "comp").alias("comp")))
        now = jumped.agg(F.sum("comp").alias("s")).first()["s"]
        scratch.drop(labels, new)
        labels = jumped
        if now == total:
            break
        total = now
    return labels
