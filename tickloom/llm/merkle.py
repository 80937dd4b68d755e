"""Merkle dataset manifest by cogrouped subtree exchange.

Every row is a leaf. Leaves of a group (a source) stand in the order of their key; while several nodes are left, each RUN consecutive ones become
their digest. Roots of groups, in order of the groups, likewise become the root of the data set. Leaves are put in order by ranges, so a group
that holds most rows is spread over all tasks. A superblock of RUN ** levels nodes goes to one task: on the way up it becomes one node, and
superblocks of these nodes follow until one is left. On the way down, nodes and what they need from outside (digests beside the superblock's own
path) are cogrouped by superblock; a task finishes the reduction inside, joins proofs, and folds them. Texts are hashed once, where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, quoted, written

#: Nodes of a run, and levels of runs in a superblock.
RUN, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes, and those of each level above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + RUN])) for i in range(0, len(out[-1]), RUN)])
    return out


def proofs(nodes: list[str], levels: int, outer: str) -> list[str]:
    """Each node's proof: its steps inside the superblock, then those outside."""
    above = [outer]
    for row in reversed(reduced(nodes, levels)[:-1]):
        steps = ["".join(row[i - i % RUN : i]) + "|" + "".join(row[i + 1 : i - i % RUN + RUN]) for i in range(len(row))]
        above = [step + ";" + above[i // RUN] if above[i // RUN] else step for i, step in enumerate(steps)]
    return above


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof lead to."""
    for step in proof.split(";") if proof else ():
        before, _, after = step.partition("|")
        leaf = digest(before + leaf + after)
    return leaf


def encoded(*fields: Column) -> Column:
    """Each field as '-' if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def placed(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (grp, key, node, ...) written in order, with their place in their group (at, from 0) and the group's size (n).

    The order is that of key, null first; equal keys stand in the order of their digests.
    """
    order = ["grp", "key", *(c for c in nodes.columns if c not in ("grp", "key"))]
    lying = written(nodes.repartitionByRange(*order[:3]).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33).alias("part")  # a partition's rows are numbered from its own number in the upper bits
    counts = lying.groupBy("grp", part).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    starts = counts.select("grp", "part", (F.sum("rows").over(group.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return lying.withColumn("part", part).join(starts, ["grp", "part"]).select(*nodes.columns, (F.col("row") + F.col("shift")).alias("at"), "n")


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes with the number of their superblock."""
    return nodes.withColumn("block", F.expr(f"at div {RUN**levels}"))


def raised(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """One node (grp, node, at, n) for each superblock."""

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("at"), int(rows["n"].iat[0])
        top = reduced(rows["node"].tolist(), min(levels, height(n)))[-1]
        return pd.DataFrame({"grp": [key[0]], "node": top, "at": [key[1]], "n": [-(-n // RUN**levels)]})

    return written(blocks(nodes.select("grp", "node", "at", "n"), levels).groupBy("grp", "block").applyInPandas(up, "grp string, node string, at long, n long"), name)


def levels_of(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Nodes and the superblocks above them, up to a last level of one node for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1 or len(out) == 1:
        out.append(raised(out[-1], levels, f"{name}{len(out)}"))
    return out


def descended(nodes: DataFrame, outer: DataFrame, levels: int, result: str) -> DataFrame:
    """Nodes cogrouped with what lies outside their superblock, outer (grp, block, proof, subroot, root): each node's proof, and its fold.

    A node that is seen otherwise (column seen) is folded as it is seen.
    """
    names = [part.split()[0].strip("`") for part in result.split(", ")]

    def down(key: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        for c in ("subroot", "root"):
            rows[c] = others[c].iat[0]
        rows["proof"] = proofs(rows["node"].tolist(), min(levels, height(int(rows["n"].iat[0]))), others["proof"].iat[0])
        if "seen" in rows:
            rows["folded_root"] = [fold(x, p) for x, p in zip(rows["seen"], rows["proof"])]
        return rows[names]

    return blocks(nodes, levels).groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(down, result)


def outside(rows: Sequence[DataFrame], outer: DataFrame, levels: int, name: str) -> DataFrame:
    """What the superblocks of the lowest level need, from what the single node above them all needs."""
    for i, nodes in enumerate(reversed(rows[1:-1])):
        found = descended(nodes, outer, levels, "grp string, at long, proof string, subroot string, root string")
        outer = written(found.withColumnRenamed("at", "block"), f"{name}{i}")
    return outer


def manifest(df: DataFrame, seen: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """key, group, position, leaf, subroot, root, proof, folded_root, verified: one row for each row of df.

    seen says what fields hold when they are verified, where that is not what they held when the manifest was made; folded_root comes from the leaf
    as it is seen and the original proof, and verified says whether it is the root. A proof has a step for each level, parted by semicolons: the
    digests before and after the node in its run, parted by a bar. A group of one leaf has that leaf as its subroot; a single group's is the root.

    A null field, group or key is an own value; null keys and the null group come first. Rows equal in group and key stand in the order of their
    leaves, so repeated rows get a place each. An empty table gives an empty result. Other columns play no part, whatever their names.
    """
    bound_batches(df.sparkSession)
    own = {f: F.col(quoted(f)) for f in fields}
    now = own | {f: c for f, c in (seen or {}).items()}
    leaf, later = (F.sha2(encoded(*(x[f] for f in fields)), 256) for x in (own, now))
    named = F.coalesce(F.concat(F.lit("+"), F.col(quoted(group)).cast("string")), F.lit(""))  # the null group comes first
    kind = df.select(F.col(quoted(key))).dtypes[0][1]
    leaves = placed(written(df.select(named.alias("grp"), F.col(quoted(key)).alias("key"), leaf.alias("node"), later.alias("seen")), "digests"), "leaves")
    within = levels_of(leaves, levels, "within")
    roots = within[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node")
    across = levels_of(placed(roots, "groups"), levels, "across")
    top = across[-1].select("grp", F.lit(0).cast("long").alias("block"), F.lit("").alias("proof"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    of_groups = descended(across[0], outside(across, top, levels, "beside"), levels, "key string, node string, proof string, root string")
    tops = written(of_groups.select(F.col("key").alias("grp"), F.lit(0).cast("long").alias("block"), "proof", F.col("node").alias("subroot"), "root"), "tops")
    found = descended(leaves, outside(within, tops, levels, "around"), levels, f"grp string, key {kind}, at long, node string, subroot string, root string, proof string, folded_root string")
    group_out = F.when(F.col("grp") != "", F.expr("substr(grp, 2)"))
    return found.select(F.col("key").alias(key), group_out.alias(group), F.col("at").alias("position"), F.col("node").alias("leaf"), "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def without_line_feeds(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Texts as seen after a tampering that deletes line feeds where 2 divides the CRC-32 of the key in decimal."""
    hit = F.crc32(F.col(quoted(key)).cast("string")) % 2 == 0
    return {text: F.when(hit, F.replace(F.col(quoted(text)), F.lit("\n"), F.lit(""))).otherwise(F.col(quoted(text)))}
