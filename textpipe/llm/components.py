"""Connected components of a graph of links, distributed.

Labels travel along links and shortcuts between labels halve the distances, so the number
of rounds grows with the logarithm of a component's diameter.  Each round is joins and
minimum aggregates (partial sums before the shuffle) on the vertices that have links, and
its result is a written table in the shared folder.  Nothing but two counts reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``v`` and ``root`` (the smallest vertex that can be reached) of every vertex of a link; no links, no rows.

    Null ends are ignored; repeated and self links are harmless.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # Both directions come from one row, so that the links are computed once.
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = written(both.select(F.inline(ways)).distinct(), "links")
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        # Smallest label among each vertex' neighbours ...
        seen = edges.join(labels.select(F.col("v").alias("w"), F.col("root").alias("r")), F.col("v") == F.col("w")).groupBy("u").agg(F.min("r").alias("m"))
        near = written(labels.join(seen, F.col("v") == F.col("u")).select("v", "root", F.least("root", "m").alias("best")), "near")
        # ... is offered to the vertex' own label as well (hooking), then every vertex takes its label's label (shortcut).
        offers = near.select(F.col("root").alias("w"), "best").union(near.select(F.col("v").alias("w"), "best")).groupBy("w").agg(F.min("best").alias("r"))
        # Written, so that the join stands right above two exchanges and a label that very many have can be split.
        offers = written(offers, "offers")
        new = near.join(offers, near["best"] == offers["w"]).select("v", F.least("best", "r").alias("root"), F.col("root").alias("old"))
        new = written(new, "labels")
        changed = new.where("root <> old").limit(1).count()
        dropped(labels, near, offers)
        labels = new
        if not changed:
            dropped(edges)
            return new.select("v", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
