"""A Merkle manifest of a table: leaves per row, trees per language, proofs by nested leaf-rank intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.operators.windows import number_in_order
from usagelens.sources.workspace import cut_lineage

#: Consecutive nodes that become one node of the next level.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<before:string,after:string>>"


def digest_of(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the values as told-apart text: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*told), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``doc_id, tree, rank, leaf, found``: every row's leaf, its place in the tree of its language, and its leaf as found later.

    ``tree`` is empty for the null language and else the language behind an equals sign, so that
    the order of trees is that of languages, null first. Where ``tampered`` holds, ``found`` has
    the text with A-Z in lower case. Ranks ascend by id, null ids first, and by leaf where ids
    repeat; rows that are equal throughout take ranks in some order, which no result depends on.
    """
    plain = {f: F.col(f) for f in fields}
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(tampered, digest_of(*(plain | {text_col: lowered}).values()))
    hashed = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("tree"),
        digest_of(*plain.values()).alias("leaf"), found.alias("found"),
    )
    ranked = number_in_order(hashed, ["tree"], ["doc_id", "leaf"], name="rank")
    return cut_lineage(ranked.select("doc_id", "tree", (F.col("rank") - 1).alias("rank"), "leaf", F.coalesce("found", "leaf").alias("found")))


def _levels(nodes: DataFrame, sizes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The parents of each level, lowest first, and the top node ``tree, digest`` of every tree.

    A node has the interval ``[low, high)`` of the leaf ranks that it covers. A parent has in
    ``children`` what its interval contains, in order; a group is ``fanout`` nodes at most.
    Trees leave as soon as one node is left of them.
    """
    largest = sizes.agg(F.max("n")).first()[0] or 0
    nodes, width, parents, tops = nodes.join(sizes, "tree"), 1, [], []
    while True:
        # A tree of n leaves is one node of this level when an interval of this width holds all.
        tops.append(nodes.where(F.col("n") <= width).select("tree", "digest"))
        if width >= largest:
            return parents, reduce(DataFrame.unionByName, tops)
        width *= fanout
        bucket = F.floor(F.col("low") / F.lit(width)).cast("long")
        grouped = nodes.where(F.col("n") > width // fanout).groupBy("tree", "n", bucket.alias("bucket")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("low", "high", "digest"))).alias("children"))
        level = cut_lineage(grouped.withColumn("digest", F.sha2(_joined(F.col("children.digest")), 256)))
        parents.append(level)
        nodes = level.select("tree", "n", "low", "high", "digest")


def _forest(tops: DataFrame) -> DataFrame:
    """``tree, root, path``: the root over all trees, and as its only step the subroots before and after the tree's own. One row per tree, as proofs need."""
    everything = tops.agg(F.sort_array(F.collect_list(F.struct("tree", "digest"))).alias("all"))
    each = everything.select(F.sha2(_joined(F.col("all.digest")), 256).alias("root"), "all", F.explode("all").alias("one"))
    before = F.filter("all", lambda x: x["tree"] < F.col("one.tree"))
    after = F.filter("all", lambda x: x["tree"] > F.col("one.tree"))
    step = F.struct(_joined(before["digest"]).alias("before"), _joined(after["digest"]).alias("after"))
    return each.select(F.col("one.tree").alias("tree"), F.col("one.digest").alias("subroot"), "root", F.array(step).cast(_STEP).alias("path"))


def _sibling_step(children: Column, low: Column, high: Column) -> Column:
    """The siblings of the node that covers [low, high): what is left of its parent's interval, as text before and after it."""
    before = F.filter(children, lambda x: x["high"] <= low)
    after = F.filter(children, lambda x: x["low"] >= high)
    return F.struct(_joined(before["digest"]).alias("before"), _joined(after["digest"]).alias("after"))


def proofs(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``leaves``.

    Per tree, runs of ``fanout`` consecutive nodes become the hash of their joined digests, until
    one is left, the subroot; the subroots in order of language become the root likewise. The
    proof of a leaf is the siblings of all nodes above it, level by level, left to right;
    ``proof_sha256`` is the hash of their text, ``folded_root`` the root that the proof gives
    for ``found``, and ``verified`` whether that is the root.

    Nodes carry the interval of leaf ranks that they cover. From the top down, each level's nodes
    are joined by tree and interval bucket with the parents that contain them, and take over the
    parent's path with their own siblings, which are the parent's interval without theirs. So a
    path is built once per node, not once per leaf, and every join is on buckets of ``fanout``
    nodes at most. An empty table has no rows. A row's proof is as long as there are languages.
    """
    rows = rows.select("doc_id", "tree", "rank", "leaf", "found")
    sizes = cut_lineage(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    first = rows.select("tree", F.col("rank").alias("low"), (F.col("rank") + 1).alias("high"), F.col("leaf").alias("digest"))
    parents, tops = _levels(first, sizes, fanout)
    forest = cut_lineage(_forest(cut_lineage(tops)))

    # Of the nodes of a level: their interval, and the path from them up to the root.
    above, width = None, fanout ** len(parents)
    for level in reversed(parents):
        kept = level.select("tree", "low", "high", "children", "n")
        # The topmost node of a tree begins with the step of the forest; the others have their parent's path.
        pathed = kept.where(F.col("n") <= width).join(forest, "tree").drop("n")
        if above is not None:
            of = F.floor(F.col("low") / F.lit(width * fanout)).cast("long")
            inside = kept.where(F.col("n") > width).withColumn("bucket", of).join(above.withColumnsRenamed({"low": "up", "high": "down"}), ["tree", "bucket"])
            inside = inside.where("up <= low AND high <= down")
            step = _sibling_step(F.col("siblings"), F.col("low"), F.col("high"))
            inside = inside.withColumn("path", F.concat(F.array(step).cast(_STEP), "path"))
            pathed = pathed.unionByName(inside.select(pathed.columns))
        pathed = cut_lineage(pathed)
        above = pathed.select("tree", "low", "high", F.floor(F.col("low") / F.lit(width)).cast("long").alias("bucket"), F.col("children").alias("siblings"), "subroot", "root", "path")
        width //= fanout
    lone = rows.join(sizes.where("n = 1"), "tree").join(forest, "tree").withColumn("path", F.col("path")).drop("n")
    if above is None:
        placed = lone
    else:
        contained = rows.withColumn("bucket", F.floor(F.col("rank") / F.lit(fanout)).cast("long")).join(above, ["tree", "bucket"])
        contained = contained.where("low <= rank AND rank < high")
        step = _sibling_step(F.col("siblings"), F.col("rank"), F.col("rank") + 1)
        placed = contained.withColumn("path", F.concat(F.array(step).cast(_STEP), "path")).select(lone.columns).unionByName(lone)
    proof = _joined(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    folded = F.aggregate("path", F.col("found"), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
    made = placed.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tampered: Column, fanout: int = FANOUT) -> DataFrame:
    """The proofs of all rows of ``docs``, some of which are found ``tampered`` with; see ``leaves`` and ``proofs``."""
    return proofs(leaves(docs, tampered), fanout)
