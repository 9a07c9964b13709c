"""Connected components of a graph given as edges, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeforge.sources.tables import Stage


def _distinct_links(links: DataFrame) -> DataFrame:
    return links.filter("high != low").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least node it knows."""
    both = links.selectExpr("high AS node", "low AS other").union(
        links.selectExpr("low AS node", "high AS other")
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    hung = both.join(least, "node").filter("other > node")
    return _distinct_links(hung.selectExpr("other AS high", "least AS low"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    hung = links.join(least, "high")
    moved = hung.selectExpr("low AS high", "least AS low")
    return _distinct_links(moved.union(least.selectExpr("high", "least AS low")))


def _fingerprint(links: DataFrame) -> tuple:
    """Changes when the set of links changes."""
    mark = F.xxhash64("high", "low").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mark)).first())


def connected_components(edges: DataFrame, stage: Stage, name: str = "links") -> DataFrame:
    """``node, component`` (the least node) for every node of ``edges(a, b)``.

    Alternates large and small stars until the links stand still, which takes a number of
    rounds that grows with the logarithm of the number of nodes. A round joins links with one row
    per node, so a node with very many neighbours is an ordinary skewed join side, and each
    round is written to the shared folder: no lineage grows and nothing is collected. Edges
    from a node to itself and repeated edges are ignored; no edges give no rows.
    """
    links = edges.selectExpr("greatest(a, b) AS high", "least(a, b) AS low")
    stage.write(f"{name}-0", _distinct_links(links))
    links, before, done = stage.read(f"{name}-0"), None, 0
    while (now := _fingerprint(links)) != before:
        before, done = now, done + 1
        stage.write(f"{name}-{done}", _small_star(_large_star(links)))
        links = stage.read(f"{name}-{done}")
    roots = links.selectExpr("low AS node", "low AS component").distinct()
    return links.selectExpr("high AS node", "low AS component").union(roots)
