"""Merkle manifest of a dataset: postorder append logs, built by aligned builders.

Rows are leaves of a tree for each group; the groups' roots are leaves of one tree above.  Runs of
``ARITY`` nodes become one node, level by level.  A builder takes an aligned block of ``BLOCK``
leaves (a power of the arity), so its nodes are a whole subtree, and appends them to the log in the
order in which they are complete: children first.  The place of any node follows from the sizes of
the subtrees before it (:func:`place`), so siblings are addressed in the log without an index.  Block
roots are the leaves of the builders above, until one node is left; no builder sees more than a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize
from gridloom.llm.ordering import ranked, sorted_rows

ARITY = 3
#: Leaves of a block: a power of the arity.
BLOCK = ARITY**8
_SEGMENT = "g string, block long, total long, n long, root string, log array<string>, ids array<long>, shown array<string>, labels array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int, height: int | None = None) -> list[int]:
    """Nodes of each level over ``n`` leaves, up to one node or, if given, for ``height`` levels above the leaves."""
    out = [n]
    while (len(out) <= height) if height is not None else out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def place(level: int, index: int, width: list[int]) -> int:
    """Place of a node in its tree's postorder log.

    Complete before it are, at its own level and below, the nodes of the subtrees up to its own, and,
    above, the nodes whose last child came before.
    """
    below = sum(min((index + 1) * ARITY ** (level - j), width[j]) for j in range(level + 1))
    return below - 1 + sum(index // ARITY ** (j - level) for j in range(level + 1, len(width)))


def append_log(leaves: list[str], height: int | None = None) -> list[str]:
    """Nodes of the tree in the order of their completion; the last is the root."""
    width, log = widths(len(leaves), height), []
    open_nodes = [[] for _ in width]  # children that wait for their run to fill
    for k, leaf in enumerate(leaves):
        log.append(leaf)
        open_nodes[0].append(leaf)
        level, last = 0, k == len(leaves) - 1
        while level < len(width) - 1 and (last or len(open_nodes[level]) == ARITY):
            node = digest(*open_nodes[level])
            open_nodes[level] = []
            log.append(node)
            open_nodes[level + 1].append(node)
            level += 1
    return log


def siblings(log: list[str], index: int, width: list[int]) -> list[tuple[str, str]]:
    """For each level, the digests to the left and to the right of the path from a leaf in its run, read from the log by place."""
    out = []
    for level in range(len(width) - 1):
        first = index - index % ARITY
        run = range(first, min(first + ARITY, width[level]))
        out.append(("".join(log[place(level, k, width)] for k in run if k < index), "".join(log[place(level, k, width)] for k in run if k > index)))
        index //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its path lead to."""
    for left, right in path:
        node = digest(left, node, right)
    return node


def _path_text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def _path(text: str | None) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in text.split(";")] if text else []


def _height(total: int, block: int) -> int | None:
    """A group of several blocks has whole blocks below: also its last one ends at their level."""
    return None if total <= block else len(widths(block)) - 1


def _build(rows: pa.Table, size: int) -> pa.Table:
    rows = rows.sort_by("pos")
    total = rows["total"][0].as_py()
    log = append_log(rows["node"].to_pylist(), _height(total, size))
    one = [[rows["g"][0].as_py()], [rows["block"][0].as_py()], [total], [rows.num_rows], [log[-1]], [log], [rows["id"].to_pylist()], [rows["shown"].to_pylist()], [rows["label"].to_pylist()]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.table([pa.array(v, k) for v, k in zip(one, kinds)], ["g", "block", "total", "n", "root", "log", "ids", "shown", "labels"])


@dataclass
class Log:
    """Segments of the logs of all groups, one table for each tier of builders, and the leaves of a block."""

    tiers: list[DataFrame]
    size: int

    def roots(self) -> DataFrame:
        """g and root of every group."""
        return reduce(DataFrame.union, [t.where(F.col("total") <= self.size).select("g", "root") for t in self.tiers])


def build(rows: DataFrame, size: int = BLOCK) -> Log:
    """Logs over ranked nodes (g, pos, total, node, and id, shown, label, which are carried along), in blocks of ``size`` leaves."""
    tiers = []
    while True:
        dealt = rows.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
        built = dealt.groupBy("g", "block").applyInArrow(lambda t: _build(t, size), _SEGMENT)
        tiers.append(materialize(built, f"log-{len(tiers)}"))
        above = tiers[-1].where(F.col("total") > size)
        if above.isEmpty():
            return Log(tiers, size)
        none = F.lit(None)
        rows = above.select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("node"),
            none.cast("long").alias("id"), none.cast("string").alias("shown"), none.cast("string").alias("label"),
        )


def _each(batches, size, emit, names, kinds):
    for batch in batches:
        for at in range(batch.num_rows):  # a row holds a whole block
            row = batch.slice(at, 1).to_pylist()[0]
            width = widths(row["n"], _height(row["total"], size))
            columns = emit(row, width, _path(row["above"]))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds)], names)


def _child_paths(segments: DataFrame, size: int) -> DataFrame:
    """g, at, label and path of every leaf of the segments: the way from it to its group's root, and further if ``above`` goes on."""

    def emit(row, width, above):
        at = [row["block"] * size + k for k in range(row["n"])]
        return [row["g"]] * row["n"], at, row["labels"], [_path_text(siblings(row["log"], k, width) + above) for k in range(row["n"])]

    names, kinds = ["g", "at", "label", "path"], [pa.string(), pa.int64(), pa.string(), pa.string()]
    read = segments.select("g", "block", "total", "n", "log", "labels", "above")
    return read.mapInArrow(lambda batches: _each(batches, size, emit, names, kinds), "g string, at long, label string, path string")


def _proofs(segments: DataFrame, size: int) -> DataFrame:
    """One row for each leaf of the lowest tier."""

    def emit(row, width, above):
        known = [left + right for left, right in above]
        leaves, hashes, folded = [], [], []
        for k, shown in enumerate(row["shown"]):
            own = siblings(row["log"], k, width)
            leaves.append(row["log"][place(0, k, width)])
            hashes.append(digest(*(left + right for left, right in own), *known))
            folded.append(fold(leaves[-1] if shown is None else shown, own + above))
        return row["ids"], [row["g"]] * row["n"], leaves, [row["subroot"]] * row["n"], hashes, folded

    names, kinds = ["doc_id", "g", "leaf", "subroot", "proof_sha256", "folded_root"], [pa.int64()] + [pa.string()] * 5
    read = segments.select("g", "block", "total", "n", "log", "ids", "shown", "subroot", "above")
    return read.mapInArrow(lambda batches: _each(batches, size, emit, names, kinds), "doc_id long, g string, leaf string, subroot string, proof_sha256 string, folded_root string")


def paths_to_top(log: Log, tops: DataFrame | None) -> DataFrame:
    """Segments of the lowest tier with ``above``, the path from their root to the last root.

    ``tops`` (top, subroot, path) holds, for every group, the path on from its own root; None ends there.
    """
    end = F.lit("")
    down = None  # g, at, path of the roots of the tier below
    for tier in reversed(log.tiers):
        last = tier.where(F.col("total") <= log.size)
        if tops is None:
            last = last.withColumn("subroot", F.col("root")).withColumn("above", end)
        else:
            last = last.join(tops, F.col("g").eqNullSafe(F.col("top"))).withColumnRenamed("path", "above").drop("top")
        if down is not None:
            inner = tier.where(F.col("total") > log.size).join(down, F.col("g").eqNullSafe(F.col("dg")) & (F.col("block") == F.col("at")))
            last = last.unionByName(inner.withColumnRenamed("path", "above").drop("dg", "at", "label"))
        if tier is log.tiers[0]:
            return last
        paths = materialize(_child_paths(last, log.size), "paths")
        names = last.select(F.col("g").alias("sg"), "subroot").distinct()
        down = paths.join(names, F.col("g").eqNullSafe(F.col("sg"))).select(F.col("g").alias("dg"), "at", "label", "path", "subroot")
    return last


def prove(leaves: DataFrame, size: int = BLOCK) -> tuple[Log, DataFrame]:
    """(log of the groups, proofs) of leaves (doc_id long, source, leaf, shown).

    ``shown`` is the digest that a reader holds against the root (null: the leaf itself).  Leaves of
    a source ascend by doc_id (null first), equal ids by leaf.  Proofs have doc_id, source, leaf,
    subroot, root, proof_sha256, folded_root and verified.  Without leaves there is no root and no row.
    """
    rows = materialize(leaves.select("doc_id", "source", "leaf", "shown"), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    placed = ranked(sorted_rows(rows, *order), "source")
    label = F.lit(None).cast("string").alias("label")
    log = build(placed.select(F.col("source").alias("g"), "pos", "total", F.col("leaf").alias("node"), F.col("doc_id").alias("id"), "shown", label), size)
    subroots = materialize(log.roots().withColumn("_all", F.lit("")), "subroots")
    top = ranked(sorted_rows(subroots, F.col("g").asc_nulls_first()), "_all")
    none = F.lit(None)
    over = build(top.select(F.col("_all").alias("g"), "pos", "total", F.col("root").alias("node"), none.cast("long").alias("id"), none.cast("string").alias("shown"), F.col("g").alias("label")), size)
    found = over.roots().first()  # one row, or none without leaves
    tops = _child_paths(paths_to_top(over, None), size).select(F.col("label").alias("top"), "path")
    tops = tops.join(subroots.select(F.col("g").alias("sg"), F.col("root").alias("subroot")), F.col("top").eqNullSafe(F.col("sg"))).select("top", "subroot", "path")
    tops = materialize(tops, "tops")
    rows = _proofs(paths_to_top(log, tops), size)
    root = F.lit(found.root if found else None).cast("string")
    return log, rows.select("doc_id", F.col("g").alias("source"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def field(value: Column) -> Column:
    """A value as its part of a leaf: byte count, colon and text; a dash if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document (doc_id, source, lang, n_chars, text).

    Where 2 divides the CRC-32 of the decimal id (null: the empty text), the reader's copy has lost
    the line feeds of its text; such rows are verified only if there were none.
    """
    keep = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    torn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    shown = F.when(torn & F.contains(text, F.lit("\n")), leaf_of(*keep, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of(*keep, text).alias("leaf"), shown.alias("shown"))
    return prove(leaves)[1].drop("source")
