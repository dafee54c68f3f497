"""Merkle manifest of a dataset by nested-interval labels.

Rows are leaves, ranked within their group. Every node of a group's tree carries the interval of leaf ranks that
it covers. A parent covers two consecutive nodes (the last one may be alone) and is the hash of their digests. The
roots of the groups are the leaves of one more tree.

Levels are worked in buckets of five. Within a bucket, a chunk of at most 32 consecutive nodes and all nodes above
them share one join key, so every group of rows is small whatever the size of the tree. A node meets its ancestors'
siblings by containment: a sibling is a node whose parent's interval contains the node's interval, while its own
does not (the difference of the two intervals). What lies above a chunk is attached to the chunk, not to each leaf.

Ranks come from range partitions: rows are sorted within each, and only a count for each (group, partition) is
added up. A group may hold any share of the rows.

Cases: nulls have their own mark in a leaf; a null group is a group of its own, before all others; null order keys
come first; rows that are equal in group and order keys are ordered by their leaf, so repeated rows give the same
tree in any order; other columns pass by; an empty table gives an empty result. A very long text is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairload.llm.common import written

#: Levels in a bucket: a chunk has at most 2 ** BUCKET leaves.
BUCKET = 5
NO_STEPS = "array<struct<left:string,right:string>>"


def marked(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(marked, fields)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(steps, leaf, lambda seen, s: F.sha2(F.concat(s.left, seen, s.right), 256))


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.left, s.right)), ""), 256)


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``rank`` within ``tree`` by the order columns, from 0, and ``n``, the rows of the tree."""
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("spread")]
    placed = rows.withColumn("spread", F.rand(7))  # equal rows may lie in several partitions
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("spread")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), f"{label}-placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "tree",
        "part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("rows").over(tree).alias("n"),
    )
    ranked = placed.join(starts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("offset"))
    return written(ranked.drop("part", "at", "offset"), f"{label}-ranked")


def _pairs(nodes: Column) -> Column:
    """Parents of consecutive nodes: interval and digest."""

    def parent(i: Column) -> Column:
        left, right = F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)
        digest = F.sha2(F.concat(left.digest, F.coalesce(right.digest, F.lit(""))), 256)
        return F.struct(left.lo.alias("lo"), F.coalesce(right.hi, left.hi).alias("hi"), digest.alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), parent)


def _chunks(nodes: DataFrame, bucket: int, label: str) -> DataFrame:
    """(tree, n, chunk, l0 .. l5): the nodes (tree, n, lo, hi, digest) of one level and up to five levels above.

    A level stands only while the one below it has several nodes in the whole tree.
    """
    base = BUCKET * bucket
    chunk = F.shiftright("lo", base + BUCKET).alias("chunk")
    listed = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("l0")  # 32 nodes at most
    built = nodes.groupBy("tree", "n", chunk).agg(listed)
    for k in range(1, BUCKET + 1):
        stands = F.col("n") > F.lit(1 << (base + k - 1))
        built = built.withColumn(f"l{k}", F.when(stands, _pairs(F.col(f"l{k - 1}"))))
    return written(built, f"{label}-{bucket}")


def _top(built: DataFrame) -> Column:
    return F.coalesce(*(F.col(f"l{k}") for k in range(BUCKET, -1, -1)))[0]


def _grow(leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Chunks of every bucket of levels, and the root (tree, digest) of each tree."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes = leaves.select("tree", "n", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    chunks, roots = [], None
    while True:
        built = _chunks(nodes, len(chunks), label)
        chunks.append(built)
        tops = built.select("tree", "n", _top(built).alias("top"))
        whole = F.col("n") <= F.lit(1 << (BUCKET * len(chunks)))
        ready = tops.where(whole).select("tree", F.col("top.digest").alias("digest"))
        roots = ready if roots is None else roots.union(ready)
        if most <= 1 << (BUCKET * len(chunks)):
            return chunks, roots
        nodes = tops.where(~whole).select("tree", "n", "top.*")


def _siblings(built: DataFrame) -> DataFrame:
    """(tree, chunk, level, lo, hi, digest, above_lo, above_hi): nodes with the interval of their parent."""

    def with_parent(k: int) -> Column:
        above = F.col(f"l{k + 1}")
        return F.transform(
            F.when(above.isNotNull(), F.col(f"l{k}")),
            lambda x, i: F.struct(
                F.lit(k).alias("level"), x.lo.alias("lo"), x.hi.alias("hi"), x.digest.alias("digest"),
                F.get(above, F.shiftright(i, 1)).lo.alias("above_lo"), F.get(above, F.shiftright(i, 1)).hi.alias("above_hi"),
            ),
        )

    none = F.array().cast("array<struct<level:int,lo:bigint,hi:bigint,digest:string,above_lo:bigint,above_hi:bigint>>")
    levels = (F.coalesce(with_parent(k), none) for k in range(BUCKET))
    return built.select("tree", "chunk", F.inline(F.concat(*levels)))


def _climb(members: DataFrame, built: DataFrame, above: DataFrame, bucket: int) -> DataFrame:
    """``members`` (tree, n, first, last and more) with ``steps`` up to the root and all columns of ``above``.

    ``above`` has a row for each chunk (tree, chunk, steps and more).
    """
    chunk = F.shiftright("first", BUCKET * (bucket + 1))
    members = members.withColumn("chunk", chunk)
    contained = (F.col("s.above_lo") <= F.col("m.first")) & (F.col("m.last") <= F.col("s.above_hi"))
    own = (F.col("s.lo") <= F.col("m.first")) & (F.col("m.last") <= F.col("s.hi"))
    same = (F.col("m.tree") == F.col("s.tree")) & (F.col("m.chunk") == F.col("s.chunk"))
    met = members.alias("m").join(_siblings(built).alias("s"), same & contained & ~own, "left")
    is_left = F.col("s.lo") < F.col("m.first")
    step = F.struct(
        F.col("s.level").alias("level"),
        F.when(is_left, F.col("s.digest")).otherwise("").alias("left"),
        F.when(is_left, "").otherwise(F.col("s.digest")).alias("right"),
    )
    found = met.groupBy(*(F.col(f"m.{c}").alias(c) for c in members.columns)).agg(
        F.collect_list(F.when(F.col("s.level").isNotNull(), step)).alias("found")  # one a level at most
    )
    base = BUCKET * bucket
    height = sum((F.col("n") > F.lit(1 << (base + k))).cast("int") for k in range(BUCKET))
    alone = F.struct(F.lit("").alias("left"), F.lit("").alias("right"))

    def at_level(k: Column) -> Column:
        met = F.get(F.filter("found", lambda s: s.level == k), F.lit(0))
        return F.when(met.isNotNull(), F.struct(met.left.alias("left"), met.right.alias("right"))).otherwise(alone)

    own_steps = F.transform(F.slice(F.array(*map(F.lit, range(BUCKET))), F.lit(1), height), at_level)
    joined = found.join(above.withColumnRenamed("steps", "later"), ["tree", "chunk"])
    return joined.withColumn("steps", F.concat(own_steps, "later")).drop("found", "later", "chunk")


def _descend(chunks: list[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """(tree, chunk, steps and more of ``tops``) of the lowest chunks; ``tops`` has a row a tree with its steps."""
    more = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for bucket in range(len(chunks) - 1, -1, -1):
        built = chunks[bucket]
        whole = F.col("n") <= F.lit(1 << (BUCKET * (bucket + 1)))
        here = built.where(whole).select("tree", "chunk").join(tops, "tree").select("tree", "chunk", "steps", *more)
        if above is not None:  # chunks whose top is a node of the next bucket
            nodes = chunks[bucket + 1].select("tree", "n", F.inline("l0"))
            nodes = nodes.select("tree", "n", F.col("lo").alias("first"), F.col("hi").alias("last"))
            climbed = _climb(nodes, chunks[bucket + 1], above, bucket + 1)
            chunk = F.shiftright("first", BUCKET * (bucket + 1)).alias("chunk")
            here = here.union(climbed.select("tree", chunk, "steps", *more))
        above = written(here, f"{label}-above-{bucket}")
    return above


def manifest(rows: DataFrame, order: str = "doc_id", label: str = "merkle") -> DataFrame:
    """The rows (group, ``order``, leaf and more) with their proof: rank in the group, subroot, root and steps.

    ``steps`` are the siblings from the leaf to the root, one entry a level, empty where a node is alone.
    ``group`` is text. Groups follow each other by their UTF-8 bytes, the null group first.
    """
    rows = rows.withColumn("tree", marked(F.col("group")))
    leaves = _ranked(rows, [order, "leaf"], label)
    chunks, subroots = _grow(leaves.withColumnRenamed("leaf", "digest"), label)
    named = subroots.withColumnRenamed("tree", "name").withColumnRenamed("digest", "leaf")
    group = F.when(F.col("name") != "-", F.expr("substring(name, instr(name, ':') + 1)")).alias("group")
    named = named.select("name", "leaf", group, F.lit("").alias("tree"))
    tops = _ranked(named, ["group", "leaf"], f"{label}-groups")
    upper, root = _grow(tops.withColumnRenamed("leaf", "digest"), f"{label}-groups")
    root = root.select("tree", F.col("digest").alias("root"), F.array().cast(NO_STEPS).alias("steps"))
    nodes = tops.select("tree", "n", F.col("rank").alias("first"), F.col("rank").alias("last"), "name", F.col("leaf").alias("subroot"))
    proved = _climb(nodes, upper[0], _descend(upper, root, f"{label}-groups"), 0)
    proved = written(proved.select(F.col("name").alias("tree"), "subroot", "root", "steps"), f"{label}-subroots")
    members = leaves.withColumn("first", F.col("rank")).withColumn("last", F.col("rank"))
    found = _climb(members, chunks[0], _descend(chunks, proved, label), 0)
    return found.drop("tree", "first", "last")


def proofs(docs: DataFrame, tampered: Column, changed: Column, label: str = "merkle") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, of a documents table.

    Where ``tampered`` holds, ``changed`` takes the place of n_chars in the leaf that is folded up.
    """
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = leaf_digest(*fields.values())
    other = leaf_digest(*(fields | {"n_chars": changed}).values())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("group"), leaf.alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)), other).alias("other"),
    )
    found = manifest(rows, "doc_id", label)
    folded = fold(F.coalesce("other", "leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
