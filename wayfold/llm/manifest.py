"""Merkle manifest of a dataset: block-wise trees over groups of leaves, sibling paths and their verification.

The nodes of a group are cut into aligned blocks of 256. A block keeps each of its levels as one hex string: the next level
is made by hashing 128-digit substrings (two digests, or the last one alone), and the sibling of a node is the 64-digit
substring beside it. What is left of a block is one node of the next tier, so a tier is 256 times smaller than the one below,
and no task ever holds more than one block of a tree, however large its group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import bounded, materialise

#: Levels of a block, and the nodes that it starts from.
LEVELS = 8
BLOCK = 1 << LEVELS
#: Hex digits of a digest.
DIGEST = 64
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a hyphen."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A group's name as text that is never null and sorts nulls first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `pos`, the row's place in its `grp` by `order` (nulls first), and `total`, the rows of the group.

    Rows are dealt by ranges of (grp, order), so a group of any size is spread over tasks; what goes through a window is one
    row per group and task. Rows that agree in all of it are told apart by where they were read, which deals them as well."""
    placed = rows.withColumn("_read", F.monotonically_increasing_id())
    placed = placed.repartitionByRange("grp", *order, "_read").sortWithinPartitions("grp", *order, "_read")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()).drop("_read"))
    task = F.shiftright("_at", 33)
    runs = placed.groupBy("grp", task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("grp").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "grp", "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("grp")).alias("total"),
    )
    out = placed.withColumn("_task", task).join(bounded(runs), ["grp", "_task"])
    return out.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_task", "_at", "_first", "_before")


def parents(level: Column) -> Column:
    """The level above: every two digests of the string hashed together, a last lone one by itself."""
    last = F.ceil(F.length(level) / (2 * DIGEST)).cast("int") - 1
    pair = lambda i: F.sha2(F.substring(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), last), pair), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """`(grp, pos, total, hash, item)` -> `(grp, block, total, items, levels, top)`: the items of each block in order, the levels
    that have siblings, and the node that is left. A block that is a whole group stops as soon as one node is left."""
    held = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "total").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", "item"))).alias("items")
    )
    held = held.withColumn("l0", F.array_join(F.transform("items", lambda x: x.hash), ""))
    for i in range(LEVELS):
        held = held.withColumn(f"l{i + 1}", parents(F.col(f"l{i}")))
    halvings = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    depth = F.when(F.col("total") > BLOCK, LEVELS).otherwise(halvings)
    every = [f"l{i}" for i in range(LEVELS + 1)]
    return held.withColumn("depth", depth.cast("int")).select(
        "grp", "block", "total", "items", F.slice(F.array(*every), F.lit(1), F.col("depth")).alias("levels"),
        F.element_at(F.array(*every), F.col("depth") + 1).alias("top"),
    )


def siblings(levels: Column, place: Column) -> Column:
    """What flanks the node at `place` of a block, level by level: the digest (empty if there is none) and whether it stands left."""

    def flank(level: Column, i: Column) -> Column:
        at = F.call_function("shiftright", place, i)
        return F.struct((at % 2 == 1).alias("left"), F.substring(level, at.bitwiseXOR(F.lit(1)) * DIGEST + 1, F.lit(DIGEST)).alias("digest"))

    return F.transform(levels, flank)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks of all tiers, leaves first."""
    out = []
    while True:
        out.append(materialise(blocks(nodes)))
        rest = out[-1].where(F.col("total") > BLOCK)
        if rest.isEmpty():
            return out
        total = F.ceil(F.col("total") / BLOCK).cast("long")
        nodes = rest.select("grp", F.col("block").alias("pos"), total.alias("total"), F.col("top").alias("hash"), F.lit(None).cast("string").alias("item"))


def tops(built: list[DataFrame]) -> DataFrame:
    """`(grp, top)`: the last node of every group."""
    whole = [t.where(F.col("total") <= BLOCK).select("grp", "top") for t in built]
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def paths(built: list[DataFrame], above: DataFrame) -> DataFrame:
    """`(hash, item, path, ...)` of every leaf: its siblings from the leaf to the last node of the group, then those of `above`,
    which has one row `(grp, path, ...)` per group. Paths come down tier by tier, joined per block and not per leaf."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    down = None
    for tier in reversed(built):
        found = tier.where(F.col("total") <= BLOCK).join(above, "grp")
        if down is not None:
            found = found.unionByName(tier.where(F.col("total") > BLOCK).join(down, ["grp", "block"]))
        leaves = F.transform(
            "items", lambda x: F.struct(x.hash.alias("hash"), x.item.alias("item"), x.pos.alias("pos"), siblings(F.col("levels"), (x.pos % BLOCK).cast("int")).alias("own"))
        )
        opened = found.select("grp", F.explode(leaves).alias("leaf"), "path", *more)
        down = opened.select("grp", F.col("leaf.pos").alias("block"), "leaf.hash", "leaf.item", F.concat("leaf.own", "path").alias("path"), *more)
        if tier is not built[0]:
            down = down.drop("hash", "item")
    return down


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    up = lambda node, x: F.sha2(F.when(x.left, F.concat(x.digest, node)).otherwise(F.concat(node, x.digest)), 256)
    return F.aggregate(path, start, up)


def manifest(leaves: DataFrame, order: str = "doc_id") -> DataFrame:
    """`leaves (grp, <order>, leaf, ...)` -> `(<all columns of leaves>, subroot, root, path)`: one tree per `grp` (text, see
    `group_key`) over its leaves in ascending order, and one over the groups' roots in ascending order of `grp`.

    Every two consecutive nodes of a level are hashed together, a last lone one by itself, until one is left; a lone leaf is
    itself the root of its group, and a lone group's root is the root of all. Columns of `leaves` that are named like the
    results are replaced, others are carried along. Null ids come first; rows of one id follow
    each other by their leaf; repeated rows are leaves of their own. An empty table has no rows. Joins are per
    block, on keys that are never null."""
    kept = [c for c in leaves.columns if c not in ("grp", "subroot", "root", "path")]
    named = materialise(leaves.select("grp", F.col(order).alias("_order"), F.col("leaf").alias("hash"), F.struct(*kept).alias("item")))
    built = tiers(numbered(named, ["_order", "hash"]).drop("_order"))
    roots = materialise(tops(built)).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("hash"))
    upper = tiers(numbered(roots, ["name"]).select("grp", "pos", "total", "hash", F.col("name").alias("item")))
    summit = tops(upper).select("grp", F.col("top").alias("root"), F.expr("cast(array() as array<struct<left: boolean, digest: string>>)").alias("path"))
    above = materialise(paths(upper, summit).select(F.col("item").alias("grp"), F.col("hash").alias("subroot"), "root", "path"))
    return paths(built, above).select("grp", *[F.col(f"item.`{c}`").alias(c) for c in kept], "subroot", "root", "path")


def verify(found: DataFrame, presented: str) -> DataFrame:
    """Adds `proof_sha256` (digest of the siblings from leaf to root), `folded_root` (the root that the leaf in the column
    `presented` leads to) and `verified` (whether it is the root)."""
    proof = F.sha2(F.array_join(F.transform("path", lambda x: x.digest), ""), 256)
    return found.withColumns({"proof_sha256": proof, "folded_root": fold(F.col(presented), F.col("path"))}).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
