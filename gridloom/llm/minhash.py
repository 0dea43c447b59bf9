"""Near-duplicates by circulant MinHash, banding and exact verification on full shingle sets.

Two permutations of the 32-bit universe make every coordinate of a signature: the first (sigma)
scrambles a shingle's hash, the second (pi) is applied to its scrambled place shifted round by k for
coordinate k.  Bands of coordinates only propose groups; a link needs the stated share on the full
sets.  Identical sets are one node throughout, so copies cost one row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let_go, materialize, words_of
from gridloom.llm.components import components

ROWS = 4
#: Chance that a pair at the threshold shares no band.
MISS = 1e-7
#: Sets of a candidate group that one task compares; larger groups take the block path.
GROUP = 1500
#: Sets of a large group that every member is compared with first.
LEADERS = 12
_U = np.uint64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed for a pair at the threshold to be missed with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Digests of words met before; a bounded number is kept."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        self[word] = digest = xxhash.xxh3_64_digest(word)
        return digest


_MEMO = _Hashes()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_MEMO.__getitem__, words)), "<u8")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; all words as one where there are fewer; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    take = min(width, len(h))
    x = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        x = _mix64(x + h[k : len(h) - take + 1 + k])
    return np.unique(x)


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Coordinates (documents x size) of non-empty sets: min over pi(sigma(x) + k mod 2^32)."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        upto, n = at, 0
        while upto < len(sets) and (upto == at or n + len(sets[upto]) <= 60_000):
            n += len(sets[upto])
            upto += 1
        starts = np.cumsum([0, *(len(s) for s in sets[at : upto - 1])])
        sigma = (_mix64(np.concatenate(sets[at:upto]) + _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)
        for k in range(size):
            out[at:upto, k] = np.minimum.reduceat(_pi(sigma + np.uint32(k)), starts)
        at = upto
    return out


def band_keys(sign: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bands = sign.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sign), bands)).copy()
    for r in range(rows):
        key = _mix64(key * _U(0x9E3779B97F4A7C15) + sign[:, r::rows].astype(np.uint64))
    return key.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, width) for t in part.column(2).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, band_keys(signatures([sets[k] for k in full], bands * rows), rows)):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ], ["doc_id", "uid", "n_shingles", "node", "keys"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, width).tobytes() for t in part.column(0).to_pylist()]
                own = [xxhash.xxh3_128_digest(s) == n for s, n in zip(sets, part.column(1).to_pylist())]  # another row of the same id drops out
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(sets, pa.binary())], ["node", "grp", "size", "shingles"]).filter(pa.array(own))

    return run


def _common(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first ``first`` sets with all sets, by products of 0/1 blocks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    owner, column = owner[keep], (np.cumsum(df > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((first, len(sets)), np.float32)
    width = int((df > 1).sum())
    step = max(64, 8_000_000 // max(1, len(sets)))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, (a, a + step))
        block = np.zeros((len(sets), min(step, width - a)), np.float32)
        block[owner[lo:hi], column[lo:hi] - a] = 1
        out += block[:first] @ block.T
    return out.astype(np.int64)


def _links(sets: list[np.ndarray], first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i below ``first``, that share the stated percentage of their union."""
    size = np.asarray([len(s) for s in sets], np.int64)
    both = _common(sets, first)
    np.fill_diagonal(both[:, :first], 0)
    return np.nonzero(100 * both >= percent * (size[:first, None] + size[None, :] - both))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """Least member of each node's component, and the links that make a spanning forest."""
    root, used = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            used.append((x, y))
    return [top(x) for x in range(n)], used


def _verify(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
        if len(sets) < 2:
            return pd.DataFrame({"u": [], "v": []})
        _, used = _forest(len(sets), *_links(sets, len(sets), percent))
        node = group["node"]
        return pd.DataFrame({"u": [node[x] for x, _ in used], "v": [node[y] for _, y in used]})

    return run


def _against_leaders(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, names, leaders = (batch.column(k).to_pylist() for k in (0, 3, 4))
            u, v = [], []
            for k, text in enumerate(batch.column(2)):
                own = np.frombuffer(text.as_py(), "<u8")
                for name, other in zip(names[k], leaders[k]):
                    there = np.frombuffer(other, "<u8")
                    shared = int(np.isin(own, there, assume_unique=True, kind="sort").sum()) if min(len(own), len(there)) * 100 >= percent * max(len(own), len(there)) else 0
                    if shared and 100 * shared >= percent * (len(own) + len(there) - shared):
                        u.append(node[k])
                        v.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _blocks(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rest", "node"], ascending=[False, True], ignore_index=True).drop_duplicates("node", ignore_index=True)
        sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
        first = int(group["rest"].sum())
        if not first or len(sets) < 2:
            return pd.DataFrame({"u": [], "v": []})
        _, used = _forest(len(sets), *_links(sets, first, percent))
        node = group["node"]
        return pd.DataFrame({"u": [node[x] for x, _ in used], "v": [node[y] for _, y in used]})

    return run


def _large_groups(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of candidate groups too large for one task, as forests.

    Every member is compared with a few leaders of its group; links to them settle most members.
    The members outside the largest settled part are then compared, block by block, with all
    members of the group, so the work is that remainder times the group and no link is lost.
    """
    slots = sets.withColumn("order", F.xxhash64("node")).groupBy("grp", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(LEADERS)).alias("slot"))
    lead = slots.agg(F.min_by("node", "order").alias("name"), F.min_by("shingles", "order").alias("set"))
    leaders = lead.groupBy("grp").agg(F.collect_list("name").alias("names"), F.collect_list("set").alias("sets"))  # LEADERS sets at most
    wide = sets.join(leaders, "grp").select("node", "grp", "shingles", "names", "sets")
    star = materialize(wide.mapInArrow(_against_leaders(percent), "u binary, v binary").where("u != v"), "stars")
    root = components(star)
    grouped = sets.select("node", "grp", "size").join(root.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = grouped.groupBy("grp", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    marked = grouped.join(main, "grp").select("node", "grp", (F.col("part") != F.col("main")).alias("rest"), "all", (F.col("all") - F.col("most")).alias("left"))
    rows = materialize(sets.select("node", "grp", "shingles").join(marked, ["node", "grp"]).where("left > 0"), "large-groups")
    many = lambda c: F.ceil(F.col(c) / block).cast("int")
    slot = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), many(c)).cast("int")
    every = rows.select("grp", F.explode(F.sequence(F.lit(0), many("left") - 1)).alias("i"), slot("all").alias("j"), F.lit(False).alias("rest"), "node", "shingles")
    rest = rows.where("rest").select("grp", slot("left").alias("i"), F.explode(F.sequence(F.lit(0), many("all") - 1)).alias("j"), "rest", "node", "shingles")
    return star.union(every.union(rest).groupBy("grp", "i", "j").applyInPandas(_blocks(percent), "u binary, v binary"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text; other columns are ignored).

    Two documents are linked where 100 x common >= percent x union over their distinct
    ``width``-word shingles (lower-cased A-Z, ASCII white space between words).  A text with fewer
    words is one shingle; null, empty and wordless texts have no shingle and no link.  component_id
    is the least doc_id reachable; kept marks it.  A null doc_id takes part and is null-safe: it is
    kept only where no member of its component has an id.  Repeated rows all get the same answer.
    """
    bands = bands_for(percent)
    uid = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), uid.alias("uid"), "text")
    base = materialize(rows.mapInArrow(_sketch(width, bands, ROWS), "doc_id long, uid string, n_shingles long, node binary, keys array<long>"), "sketches")
    nodes = base.where("node is not null").groupBy("node").agg(F.min("uid").alias("uid"), F.any_value("keys").alias("keys"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    groups = components(keyed.join(shared, "key").select(F.col("node").alias("u"), "v"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    wanted = groups.join(sizes, "root").join(nodes.select("node", "uid"), "node").select("uid", "node", F.col("root").alias("grp"), "size")
    texts = rows.join(wanted, "uid").select("text", "node", "grp", "size")
    sets = materialize(texts.mapInArrow(_sets(width), "node binary, grp binary, size long, shingles binary"), "sets")
    links = sets.where(F.col("size") <= group).groupBy("grp").applyInPandas(_verify(percent), "u binary, v binary")
    large = sets.where(F.col("size") > group)
    if not large.isEmpty():
        links = links.union(_large_groups(large.dropDuplicates(["node"]), percent, group // 2))
    found = components(links)
    named = found.join(nodes.select("node", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(least, "root").select("node", "component")
    final = nodes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return (
        base.select("doc_id", "n_shingles", "node")
        .join(final, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
