"""Document fingerprints by invertible Bloom lookup tables, in DataFrame operations only.

A table of cells (count, xor of digests, xor of check sums) holds the digests of a text's
paragraphs, each in one cell of three thirds.  Tables of two versions are subtracted cell by cell;
what both hold cancels.  Peeling cells that hold one digest recovers the differing digests; where it
gets stuck the table is made again, larger and with other hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of a fingerprint and of the first try; then those of each retry.
CELLS, RETRIES = 24, (60, 240, 960)
#: Rounds of peeling in the first try; each retry has a few more.
ROUNDS = 8
#: Digests of both versions that one subtable is made for; long texts have several subtables.
LOAD = 8
#: Ranges of ids that rows are dealt by; their bounds are the only thing that reaches the driver.
MOST_RANGES = 1024
#: A paragraph ends with its line or, within a line, with a sentence.
PARAGRAPH_END = r"(?<=[.!?])[ \t]+|\s*[\r\n]+\s*"


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the non-blank paragraphs; null has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.trim(p))))


def _places(key: str, cells: int, salt: int) -> str:
    """Fields that tell a digest's three cells: a bit mask up to 63 cells, else their numbers."""
    third = cells // 3
    mixed = key if not salt else f"xxhash64({key}, {salt}L)"
    at = [f"{k * third} + CAST(pmod(shiftright({mixed}, {16 * k}), {third}L) AS INT)" for k in range(3)]
    if cells < 64:
        return f"'m', {' | '.join(f'shiftleft(1L, {p})' for p in at)}"
    return ", ".join(f"'p{k}', {p}" for k, p in enumerate(at))


def _held(key: str, cells: int) -> str:
    """Whether cell j is one of a placed digest's."""
    return f"getbit({key}.m, j) = 1" if cells < 64 else f"{key}.p0 = j OR {key}.p1 = j OR {key}.p2 = j"


def _placed(keys: str, cells: int, salt: int) -> str:
    """Digests with their check sums and places."""
    return f"transform({keys}, x -> named_struct('k', x, 'h', xxhash64(x, 77L), {_places('x', cells, salt)}))"


def _table(keys: str, cells: int, salt: int = 0) -> str:
    """SQL of a table over an array of digests."""
    here = f"filter(ks, s -> {_held('s', cells)})"
    cell = f"transform(array({here}), f -> named_struct('c', size(f), 'k', aggregate(f, 0L, (a, s) -> a ^ s.k), 'h', aggregate(f, 0L, (a, s) -> a ^ s.h)))[0]"
    return f"transform(array({_placed(keys, cells, salt)}), ks -> transform(sequence(0, {cells - 1}), j -> {cell}))[0]"


def _peel(a: str, b: str, cells: int, salt: int) -> str:
    """SQL of the number of digests in which a and b differ, by subtraction and peeling; null where it gets stuck."""
    empty = "named_struct('cells', cells, 'found', 0, 'done', false)"
    minus = f"zip_with({_table(a, cells, salt)}, {_table(b, cells, salt)}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'h', p.h ^ q.h))"
    pure = f"array_distinct(transform(filter(s.cells, e -> abs(e.c) = 1 AND e.h = xxhash64(e.k, 77L)), e -> named_struct('c', e.c, 'k', e.k, 'h', e.h, {_places('e.k', cells, salt)})))"
    taken = f"aggregate(filter(ps, p -> {_held('p', cells)}), e, (t, p) -> named_struct('c', t.c - p.c, 'k', t.k ^ p.k, 'h', t.h ^ p.h))"
    step = f"transform(array({pure}), ps -> IF(size(ps) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true), named_struct('cells', transform(s.cells, (e, j) -> {taken}), 'found', s.found + size(ps), 'done', false)))[0]"
    rounds = ROUNDS + 4 * salt
    walk = f"transform(array({minus}), cells -> aggregate(sequence(1, {rounds}), {empty}, (s, r) -> IF(s.done, s, {step})))[0]"
    return f"transform(array({walk}), s -> IF(exists(s.cells, e -> e.c <> 0 OR e.k <> 0L), NULL, s.found))[0]"


def difference(a: str, b: str) -> Column:
    """Number of digests that one of two digest arrays (column names) has and the other has not.

    Texts are cut into subtables by a hash of the digest, so work grows with their length; each
    subtable is retried larger until it peels.  After the last try (about one in 10^9) the digests
    themselves are compared.
    """
    tries = [_peel("ka", "kb", cells, t) for t, cells in enumerate((CELLS, *RETRIES))]
    last = "size(array_except(ka, kb)) + size(array_except(kb, ka))"
    one = f"IF(size(ka) + size(kb) = 0, 0, coalesce({', '.join(tries)}, {last}))"

    def cut(shift: int, n: str, i: str, a: str, b: str, inner: str) -> str:
        """Sum of ``inner`` over the parts ka, kb of two digest arrays."""
        own = lambda keys: f"filter({keys}, x -> pmod(shiftright(x, {shift}), {n}) = {i})"
        part = f"transform(array(named_struct('a', {own(a)}, 'b', {own(b)})), o -> {inner})[0]"
        return f"aggregate(transform(sequence(0, {n} - 1), {i} -> {part}), 0, (t, d) -> t + d)"

    # Cut in two steps: each digest is looked at twice the square root of the number of subtables.
    second = f"transform(array(o.a), ka -> transform(array(o.b), kb -> {one})[0])[0]"
    inner = cut(36, "n", "i2", "q.a", "q.b", second)
    first = cut(50, "n", "i1", a, b, f"transform(array(o), q -> {inner})[0]")
    parts = f"greatest(1, CAST(ceil(sqrt((size({a}) + size({b})) / {LOAD}D)) AS INT))"
    return F.expr(f"transform(array({parts}), n -> {first})[0]")


def likeness(a: str, b: str) -> Column:
    """Shared digests over all digests of two arrays (0 to 1), from their sizes and their difference; two empty ones are alike."""
    both, d = F.size(a) + F.size(b), difference(a, b)
    return F.when(both == 0, 1.0).otherwise(F.transform(F.array(d), lambda x: (both - x) / (both + x))[0].cast("double"))


def fingerprint(digests: str) -> Column:
    """The table of ``CELLS`` cells as text: count, digests and check sums of each cell in hexadecimal."""
    return F.expr(f"array_join(transform({_table(digests, CELLS)}, e -> concat_ws('.', hex(e.c), hex(e.k), hex(e.h))), ' ')")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending order of doc_id, after the last that of the first.

    Rows are dealt by ranges of ids whose bounds are quantiles; each range also gets a copy of the
    first row of the next, so no order over all rows is needed in one task.  A null id counts as the
    least; rows of one id follow each other by their text.
    """
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at.alias("at"))
    ranges = max(1, min(ranges, MOST_RANGES))
    bounds = rows.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges).alias("b")).first()[0]
    if bounds is None:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    bounds = sorted(set(bounds)) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("at"))) if bounds else F.lit(0)
    rows = rows.withColumn("part", part)
    heads = sorted((r.part, r.head) for r in rows.groupBy("part").agg(F.max("at").alias("head")).collect())  # a row for each range
    after = {part: heads[k - 1][0] for k, (part, _) in enumerate(heads)}  # rows of a range are followed by the range below
    goes = {below: part for part, below in after.items()}
    target = F.create_map(*(F.lit(x) for pair in goes.items() for x in pair))
    first = rows.where(F.col("at").isin([head for _, head in heads])).withColumn("part", target[F.col("part")])
    dealt = rows.withColumn("copy", F.lit(False)).union(first.withColumn("copy", F.lit(True))).repartition(ranges, "part")
    order = Window.partitionBy("part").orderBy("copy", F.desc("at"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not copy").select("doc_id", "text", "next_text")


def document_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document (doc_id, text).

    The edited text has the last half of the code points (rounded down) replaced by the first as
    many, or all, of the next document in descending order of doc_id.  Null counts as empty; texts
    without paragraphs have an empty table; a single document is its own next.
    """
    spark = docs.sparkSession
    rows = with_next(docs, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("new"), paragraph_digests(F.col("next_text")).alias("nxt"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("new").alias("edited_fingerprint"),
        likeness("own", "new").alias("near_edited"), likeness("own", "nxt").alias("near_next"),
    )
