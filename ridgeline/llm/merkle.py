"""Merkle manifest of a table: a tree of row digests for each partition, a tree over their roots, and a proof for every row.

A node is named by its coordinates (tree, level, at); which nodes a proof needs follows from a leaf's index and the group size
alone. Leaves are put in order by a range shuffle and numbered from counts by partition, so no tree meets in one task. BAND
levels at a time, a node explodes the coordinates of its siblings there and joins the materialised node table; the levels above
are shared by all nodes below one ancestor, whose siblings are found the same way and joined once. So no coordinate is asked for
by more than group ** BAND nodes, and a proof costs BAND joined rows and not one for each level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, working_tables, written

#: Levels that one join looks up; a block of group ** BAND leaves is one row of the node table's making.
BAND = 5
#: Shares that a tree's leaves are dealt over where they meet its root.
SALTS = 64


def digest_of(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def encoded(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value; integers are decimal."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return digest_of(*[encoded(c) for c in columns])


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """rows with tree_at (a long that names the row's tree and ascends with it, null first), at (its index there, by `order`) and
    tree_size. Rows that `order` doesn't tell apart are told apart by where they were read, so a hot key fills no task."""
    pid, pos, tie = fresh(rows, "pid", "pos", "tie")
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    by = [F.col(tree).asc_nulls_first(), *order, F.col(tie)]
    placed = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop(tie).withColumn(pos, F.monotonically_increasing_id())
    placed = written(placed.withColumn(pid, F.shiftright(F.col(pos), 33).cast("int")), "placed")  # the partition number stands above bit 33
    # A row for each tree and partition; a window sees at most one row a partition.
    runs = placed.groupBy(pid, tree).agg(F.min(pos).alias("lo"), F.count("*").alias("c"))
    own = Window.partitionBy(tree)
    runs = runs.select(
        F.col(pid).alias("run_pid"), F.col(tree).alias("run_tree"), "lo", F.min("lo").over(own).alias("tree_at"), F.sum("c").over(own).alias("tree_size"),
        (F.sum("c").over(own.orderBy(pid)) - F.col("c")).alias("before"),
    )
    both = placed.join(runs, (F.col(pid) == F.col("run_pid")) & F.col(tree).eqNullSafe(F.col("run_tree")))
    at = F.col("before") + F.col(pos) - F.col("lo")
    return written(both.select(*rows.columns, "tree_at", at.alias("at"), "tree_size"), "numbered")


def depth_of(size: Column, group: int) -> Column:
    """Levels above the leaves of a tree: the least d with group ** d >= size."""
    near = F.ceil(F.log(size.cast("double")) / F.lit(math.log(group))).cast("int")
    return F.when(_reach(near, group) < size, near + 1).when((near > 0) & (_reach(near - 1, group) >= size), near - 1).otherwise(near)


def _reach(levels: Column, group: int) -> Column:
    return F.pow(F.lit(float(group)), levels.cast("double"))


def _power(levels: Column | int, group: int) -> Column:
    return F.round(F.pow(F.lit(float(group)), F.lit(levels) if isinstance(levels, int) else levels)).cast("long")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _join(digests: Column) -> Column:
    """The binary digests one after another, as one hex text."""
    return _hex(F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d)))


def node_table(leaves: DataFrame, group: int) -> DataFrame:
    """tree, size, level, at, digest (binary) for all nodes of trees of leaves (tree, size, at, digest). Blocks of group ** BAND nodes
    are folded level by level where they are; their tops are the next band's nodes. A tree ends at its own depth."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    out, level, front = None, 0, leaves.select("tree", "size", "at", "digest")
    while True:
        block = F.floor(F.col("at") / _power(BAND, group))
        blocks = front.groupBy("tree", "size", block.alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda n: n["digest"]).alias("nodes"))
        # Levels of this band that the tree has: it stops where one node is left of it.
        high = F.least(F.lit(BAND), F.greatest(F.lit(0), depth_of(F.col("size"), group) - F.lit(level)))

        def up(done: Column) -> Column:
            last = F.element_at(done, -1)
            runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / group).cast("int"))
            return F.concat(done, F.array(F.transform(runs, lambda i: F.unhex(F.sha2(_join(F.slice(last, i * group + 1, F.lit(group))).cast("binary"), 256)))))

        steps = F.when(high > 0, F.sequence(F.lit(1), high)).otherwise(F.array().cast("array<int>"))
        levels = blocks.select("tree", "size", "block", F.posexplode(F.aggregate(steps, F.array("nodes"), lambda done, i: up(done))).alias("up", "nodes"))
        first = F.col("block") * _power(F.lit(BAND) - F.col("up"), group)
        nodes = levels.select("tree", "size", (F.col("up") + level).alias("level"), first.alias("first"), F.posexplode("nodes").alias("i", "digest"))
        nodes = written(nodes.select("tree", "size", "level", (F.col("first") + F.col("i")).alias("at"), "digest"), f"nodes-{level}")
        level += BAND
        # The tops of a tree that goes on are the first level of the next band, and are kept there.
        further = F.ceil(F.col("size") / F.lit(float(group) ** level)) > 1
        here = nodes.where((F.col("level") < level) | ~further)
        out = here if out is None else out.unionByName(here)
        if float(group) ** level >= largest:
            return out
        front = nodes.where((F.col("level") == level) & further).select("tree", "size", "at", "digest")


_PROOF = "array<struct<level:int,slot:int,digest:binary>>"


def _siblings(nodes: DataFrame, table: DataFrame, low: int, group: int) -> DataFrame:
    """tree, at, low_proof: for nodes (tree, size, at) of level `low`, the siblings of them and of their ancestors in levels
    low .. low + BAND - 1, in order of level and slot. Nodes without siblings have no row."""
    high = F.least(F.lit(low + BAND), depth_of(F.col("size"), group)) - 1
    levels = F.when(high >= low, F.sequence(F.lit(low), high)).otherwise(F.array().cast("array<int>"))
    ancestor = nodes.select("tree", "at", "size", F.explode(levels).alias("level")).withColumn("own", F.floor(F.col("at") / _power(F.col("level") - low, group)))
    run = F.col("own") - F.col("own") % group
    last = F.least(run + group, F.ceil(F.col("size") / _reach(F.col("level"), group)).cast("long")) - 1
    asked = ancestor.select("tree", "at", "level", "own", F.explode(F.sequence(run, last)).alias("wanted")).where("wanted <> own").drop("own")
    found = asked.join(table.select("tree", "level", F.col("at").alias("wanted"), "digest"), ["tree", "level", "wanted"])
    entry = F.struct(F.col("level"), (F.col("wanted") % group).cast("int").alias("slot"), "digest")
    return found.groupBy("tree", "at").agg(F.sort_array(F.collect_list(entry)).cast(_PROOF).alias("low_proof"))


def with_proofs(leaves: DataFrame, table: DataFrame, group: int) -> DataFrame:
    """leaves (tree, size, at, and more) with proof: all siblings on the way to the tree's root. A lone leaf's proof is empty."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    low, none = 0, F.array().cast(_PROOF)
    while float(group) ** (low + BAND) < largest:
        low += BAND
    above = None
    while True:
        nodes = table.where(F.col("level") == low).select("tree", "size", "at") if low else leaves
        step = nodes.join(_siblings(nodes.select("tree", "size", "at"), table, low, group), ["tree", "at"], "left").withColumn("low_proof", F.coalesce("low_proof", none))
        if above is None:
            step = step.withColumn("proof", F.col("low_proof")).drop("low_proof")
        else:
            up = above.select("tree", F.col("at").alias("block"), F.col("proof").alias("high_proof"))
            step = step.withColumn("block", F.floor(F.col("at") / _power(BAND, group))).join(up, ["tree", "block"], "left")
            step = step.withColumn("proof", F.concat("low_proof", F.coalesce("high_proof", none))).drop("low_proof", "high_proof", "block")
        if not low:
            return step
        above = written(step.select("tree", "at", "proof"), f"proofs-{low}")
        low -= BAND


def folded(leaf: Column, at: Column, size: Column, proof: Column, group: int) -> Column:
    """The root (hex) that a leaf (hex) at an index and its siblings give. A level without siblings hashes the node alone."""

    def up(state: Column, level: Column) -> Column:
        slot = state["at"] % group
        side = lambda keep: _join(F.transform(F.filter(proof, lambda s: (s["level"] == level) & keep(s["slot"])), lambda s: s["digest"]))
        text = F.concat(side(lambda x: x < slot), state["digest"], side(lambda x: x > slot))
        return F.struct(F.floor(state["at"] / group).cast("long").alias("at"), F.sha2(text.cast("binary"), 256).alias("digest"))

    depth = depth_of(size, group)
    levels = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.struct(at.cast("long").alias("at"), leaf.alias("digest")), up)["digest"]


def said(proof: Column) -> Column:
    """The siblings' digests as hex, level by level, left to right."""
    return _join(F.transform(proof, lambda s: s["digest"]))


def top(table: DataFrame, group: int) -> DataFrame:
    """The last node of each tree."""
    return table.where((F.col("at") == 0) & (F.col("level") == depth_of(F.col("size"), group)))


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: int = 2, changed: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: key, leaf, subroot, root, proof (to the subroot), top_proof (on to the root), proof_sha256,
    folded_root and verified.

    A leaf is the digest of `columns`; its tree is the value of `tree`, its place the order of `key`, then of leaf. Every `group`
    consecutive nodes become their digest until one is left; the subroots, in order of `tree`, do likewise. `changed` gives columns
    as they are found later: folded_root is what the leaf of these and the original siblings give, and verified whether it is root.

    Null keys come first; rows that repeat are leaves of their own, side by side; a null tree is a tree, and the first. Null and
    empty values encode differently. Texts of any length are hashed where they are read, once for both leaves, and never move. Other
    columns, whatever their names, are ignored. No rows give no rows.
    """
    if group < 2:
        raise ValueError("a group has two nodes at least")
    with working_tables(docs.sparkSession) as keep:
        # Only digests and keys go on.
        now = {c: (changed or {}).get(c, docs[c]) for c in columns}
        same = F.lit(True)
        for c in changed or {}:
            same = same & now[c].eqNullSafe(docs[c])
        leaf = leaf_of(*[docs[c] for c in columns])
        found = F.when(~same, leaf_of(*now.values())) if changed else F.lit(None).cast("string")
        slim = written(docs.select(docs[key].alias("key"), docs[tree].alias("branch"), leaf.alias("leaf"), found.alias("found")), "leaves")
        rows = numbered(slim, "branch", [F.col("key").asc_nulls_first(), F.col("leaf")]).withColumnsRenamed({"tree_at": "tree", "tree_size": "size"})
        nodes = node_table(rows.select("tree", "size", "at", F.unhex("leaf").alias("digest")), group)

        tops = numbered(top(nodes, group).select(F.lit(0).alias("forest"), F.col("tree").alias("of"), "digest"), "forest", [F.col("of")]).withColumnsRenamed({"tree_at": "tree", "tree_size": "size"})
        crown = node_table(tops.select("tree", "size", "at", "digest"), group)
        root = top(crown, group).select("tree", F.col("digest").alias("root"))
        # A row for each tree: its root, and the proof from there on.
        tops = with_proofs(tops, crown, group).join(root, "tree")
        tops = written(tops.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("top_proof"), F.col("at").alias("top_at"), F.col("size").alias("top_size")), "tops")

        # One tree may hold most rows, so its roots are dealt over salts.
        full = with_proofs(rows, nodes, group).withColumn("salt", (F.col("at") % SALTS).cast("int"))
        full = full.join(tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["tree", "salt"])
        sub = folded(F.coalesce("found", "leaf"), F.col("at"), F.col("size"), F.col("proof"), group)
        full = full.withColumn("folded_sub", sub).withColumn("folded_root", folded(F.col("folded_sub"), F.col("top_at"), F.col("top_size"), F.col("top_proof"), group))
        whole = F.sha2(F.concat(said(F.col("proof")), said(F.col("top_proof"))).cast("binary"), 256)
        out = full.select(F.col("key").alias(key), "leaf", _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "proof", "top_proof", whole.alias("proof_sha256"), "folded_root")
        return keep(out.withColumn("verified", F.col("folded_root") == F.col("root")))
