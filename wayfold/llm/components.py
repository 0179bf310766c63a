"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialise, skew_join


def _with_minimum(links: DataFrame) -> DataFrame:
    """Every (node, other) with `low`, the smallest of the node and its others: an aggregate that combines before the
    shuffle, joined back; a hub's rows are split by the adaptive skew join, no group is gathered."""
    low = links.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    return skew_join(links, low, ["node"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        joined = _with_minimum(both).where("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    else:
        joined = _with_minimum(links)
        joined = joined.select(F.explode(F.array("node", "other")).alias("node"), F.col("low").alias("other"))
    return joined.where("node > other").distinct()


def components(links: DataFrame) -> DataFrame:
    """`links (u long, v long)`, either direction, repeats and loops allowed -> `(id, component_id)` for every id of a
    link between different ids; component_id is the smallest id reachable. Null ends are no link. Large-star and
    small-star rounds run until the table of links stops changing (a log-squared number of rounds); each round's
    table is written to the shared folder, so a lost executor costs one round at most."""
    links = materialise(
        links.where("u <> v").select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other")).distinct()
    )
    state = None
    while True:
        row = links.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if tuple(row) == state or row[0] == 0:
            break
        state = tuple(row)
        links = materialise(_star(_star(links, True), False))
    # At the fixed point every link runs from a node to the smallest id of its component.
    return links.select(F.col("node").alias("id"), F.col("other").alias("component_id")).unionByName(
        links.select(F.col("other").alias("id"), F.col("other").alias("component_id")).distinct()
    )
