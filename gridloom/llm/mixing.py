"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the same number of copies as its source needs on average, a whole part
and a fraction.  The fractions are rounded by pivots: a document and the pool of the smaller
documents of its group move words between each other, up or down by a coin whose odds keep every
expected number of copies, until the document's fraction is 0 or 1, or one of the pool's is.
Words are moved, not copies, so a group's words stay what they were.  What is left of a group is one
document, as a rule its smallest; these residuals meet in the groups of the next level of a
reduction tree, until each source has one residual.  It alone is rounded by a coin of its own, so a
source misses its target by less than that document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize
from gridloom.llm.ordering import ranked, sorted_rows

#: Documents or residuals of a group of the reduction tree, on average.
GROUP = 1024
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fractions this close to 0 or 1 are 0 or 1.
EPSILON = 1e-12
_FIELDS = "_id long, _key long, _source long, size long, source_size long, target double, copies long, p double"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_number, source_size, n_docs and target of every source of ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights in turn.  They share the words of all
    by weight; no target is above ``cap`` times its source's words, and what that leaves goes to the
    others by weight.  Each round of resharing is one sum over the sources.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    own = materialize(own.withColumn("_none", F.col("source").isNull()).withColumn("_all", F.lit(0)), "sources")
    rows = ranked(sorted_rows(own, F.col("_none").asc(), F.col("source").asc()), "_all")
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).cast("long"))
    rows = materialize(rows.select("source", F.col("pos").alias("source_number"), "source_size", "n_docs", "weight"), "weights")
    words = rows.agg(F.sum("source_size")).first()[0] or 0
    above = F.lit(cap) * F.col("source_size")
    rest, share = words, rows.agg(F.sum("weight")).first()[0] or 1
    while True:  # the capped sources only grow in number
        over = above.cast("double") * share < F.col("weight") * F.lit(float(rest))
        capped, weight = rows.agg(F.sum(F.when(over, above)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (words - (capped or 0), weight or 1)
        if now == (rest, share):
            break
        rest, share = now
    target = F.least(F.col("weight") * F.lit(float(rest)) / F.lit(float(share)), above.cast("double"))
    return rows.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))


def pivot(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, int]:
    """Fractions rounded to 0 or 1 and the place of the one that could not be (-1 if none).

    Rows come largest first.  Row i trades words with the later rows, each of which moves by the
    same multiple of its distance to the nearer end, up or down, until row i or one of them is whole;
    the coin's odds are the other way's words, so no fraction's mean changes.  A row so large that
    the later ones can balance only one of its two ends goes there without a coin, or it would be
    left over and its group far from its words.  The words of all fractions stay the same.  Every
    trade makes a row whole, so there are coins enough.
    """
    f, size, trades = p.astype(float), size.astype(float), 0
    for i in range(len(f)):
        rest, words = f[i + 1 :], size[i + 1 :]
        while EPSILON < f[i] < 1 - EPSILON:
            step = np.minimum(rest, 1 - rest)
            pool = float(step @ words)
            live = step > 0
            if not live.any():
                f[i + 1 :] = np.rint(rest)
                return f, i
            ends = rest[live] / step[live]
            up = min((1 - f[i]) * size[i], float(ends.min()) * pool)  # row i gains, the pool loses
            down = min(f[i] * size[i], float(((1 - rest[live]) / step[live]).min()) * pool)
            held = float(rest @ words)
            full, none = (1 - f[i]) * size[i] <= held, f[i] * size[i] <= float(words.sum()) - held
            moved = up if (coin[trades] * (up + down) < down if full == none else full) else -down
            trades += 1
            f[i] += moved / size[i]
            rest -= step * (moved / pool)
            rest[rest < EPSILON] = 0.0
            rest[rest > 1 - EPSILON] = 1.0
        f[i] = np.rint(f[i])
    return f, -1


def _group(rows: pa.Table) -> pa.Table:
    size, key = rows["size"].to_numpy(), rows["_key"].to_numpy()
    ids = rows["_id"].to_pandas().to_numpy(dtype=float)
    order = np.lexsort((np.nan_to_num(ids, nan=-1.0), key, -size))
    rows = rows.take(pa.array(order))
    p = rows["p"].to_numpy()
    out, left = pivot(p, rows["size"].to_numpy(), rows["coin"].to_numpy())
    whole = np.rint(out).astype(np.int64)
    rest = [None] * len(out)
    if left >= 0:
        whole[left], rest[left] = 0, float(out[left])
    copies = rows["copies"].to_numpy() + whole
    names = ["_id", "_key", "_source", "size", "source_size", "target"]
    return pa.table([rows[n] for n in names] + [pa.array(copies), pa.array(rest, pa.float64())], [*names, "copies", "p"])


def _level(rows: DataFrame, level: int, groups: Column, seed: int) -> DataFrame:
    """One level of the reduction tree: rows with copies, and ``p`` where a group left a residual."""
    coin = F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(level)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    bucket = F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(-level)), groups)
    dealt = rows.withColumn("coin", coin).withColumn("bucket", bucket)
    return materialize(dealt.groupBy("_source", "bucket").applyInArrow(_group, _FIELDS), f"level-{level}")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document (doc_id, text, source).

    ``copies`` is how often the mix takes the document (at most ``cap``), ``taken`` its words times that.
    The coins are hashes of id and text, so reruns agree.  Null texts have no words and, like all
    wordless ones, no copies; null sources are one source, the last; rows of a null id go by their
    text.  Repeated rows are rows of their own, dealt to one group together (eighty bytes a row).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_key"))
    base = materialize(base, "sizes")
    targets = materialize(source_targets(base.select("source", "size"), weights, cap), "targets")
    known = targets.select(F.col("source").alias("_name"), F.col("source_number").alias("_source"), "source_size", "n_docs", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = base.join(known, F.col("source").eqNullSafe(F.col("_name")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long")).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    fields = [f.split(" ")[0] for f in _FIELDS.split(", ")]
    is_whole = F.col("p") <= EPSILON
    done = [rows.where(is_whole).select(*fields[:-1])]
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    open_rows, level = rows.where(~is_whole).withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / group))), 0
    while True:
        out = _level(open_rows, level, F.col("_groups"), seed)
        done.append(out.where("p IS NULL").select(*fields[:-1]))
        left = out.where("p IS NOT NULL")
        most = -(-most // group)
        if most <= 1:
            break
        level += 1
        # As many residuals a source as it had groups; the next level has a group for each ``group`` of them.
        sized = targets.select(F.col("source_number").alias("_number"), F.col("n_docs"))
        counted = left.join(sized, F.col("_source") == F.col("_number"))
        open_rows = counted.withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / float(group) ** (level + 1))))
    coin = F.pmod(F.xxhash64("_key", F.lit(seed), F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    done.append(left.withColumn("copies", F.col("copies") + (coin < F.col("p")).cast("long")).select(*fields[:-1]))
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    return result.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` (unique doc_id), each as often as :func:`mix` takes it."""
    times = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    rows = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_n", "_id", "_copies")
