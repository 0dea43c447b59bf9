"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``GUARANTEE`` - ``GRAM`` + 1 consecutive word k-grams the least hash is a fingerprint, so a
text and a benchmark item that share ``window`` words in a row share a fingerprint.  Fingerprint hits
are extended to the windows that can hold them, and those are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lower_ascii, materialize

#: Words of a fingerprinted gram.
GRAM = 6
#: Fingerprints or windows of the benchmark up to which they are broadcast (about 40 MB); larger ones are joined by shuffles.
BROADCAST = 1_000_000
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before its letters A-Z are lower-cased; enough to count words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, a-z and characters outside ASCII; null has none."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _grams(hashes: str, size: int) -> Column:
    """Hash of every ``size`` consecutive words, by the place of its first."""
    return F.expr(
        f"transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({', '.join(f'get({hashes}, i + {k})' for k in range(size))}))"
    )


def _fingerprints(rows: DataFrame, key: list[str], window: int) -> DataFrame:
    """key, place and fp of the winnowed grams of rows (key, w) of at least ``window`` words; ties keep every place."""
    span = window - GRAM + 1
    own = rows.select(*key, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    own = own.select(*key, F.when(F.size("h") >= window, _grams("h", GRAM)).alias("g"))
    least = ", ".join(f"get(g, i + {k})" for k in range(span))
    own = own.select(*key, "g", F.expr(f"transform(sequence(0, size(g) - {span}), i -> least({least}))").alias("m"))
    # A gram is chosen where it is the least of a window that starts at most span - 1 places before it.
    chosen = " OR ".join(f"x = m[i - {k}]" if k == 0 else f"(i >= {k} AND x = get(m, i - {k}))" for k in range(span))
    chosen = chosen.replace("x = m[i - 0]", "x = get(m, i)")
    own = own.select(*key, F.expr(f"filter(transform(g, (x, i) -> if({chosen}, named_struct('place', i, 'fp', x), NULL)), s -> s IS NOT NULL)").alias("f"))
    # Outer: an inner explode would have Spark test the array's size in a filter that repeats the whole chain.
    return own.select(*key, F.explode_outer("f").alias("f")).select(*key, "f.place", "f.fp")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(items with their words, windows): windows holds each distinct window's text, its words and the ids of its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    taken = items.select("item", F.expr(f"""CASE WHEN size(w) < {window} THEN array(array_join(w, ' '))
        ELSE transform(sequence(1, size(w) - {window - 1}), i -> array_join(slice(w, i, {window}), ' ')) END""").alias("x"), F.least(F.size("w"), F.lit(window)).alias("n"))
    windows = taken.select("item", "n", F.explode("x").alias("win")).groupBy("win", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return items, windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash (xxhash64) of every document (doc_id, text).

    A benchmark item (item_id, text) counts where ``window`` of its words in a row, or all of them
    if it has fewer, occur in the document; n_hit counts document words inside such places.  Null
    and wordless texts have no words; wordless items count nowhere; a null item_id names no item.
    Repeated rows get the same answer; an empty benchmark hits nothing.
    """
    if window < GRAM:
        raise ValueError(f"windows have at least {GRAM} words")
    items, windows = benchmark_windows(benchmark, window)
    windows = materialize(windows, "windows")
    prints = materialize(_fingerprints(items, ["item"], window).select("fp").where("fp is not null").distinct(), "fingerprints")
    n_windows, n_prints = windows.count(), prints.count()
    short = [r.n for r in windows.where(F.col("n") < window).select("n").distinct().collect()]  # window - 1 values at most
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.xxhash64("text").alias("t"), "doc_id", "text")
    keyed = base.select("k", "t", words(F.col("text")).alias("w"))
    hits = _fingerprints(keyed, ["k", "t"], window).join(_small(prints, n_prints), "fp", "left_semi")
    # A window that holds a gram starts at most window - GRAM words before it.
    places = [hits.select("k", "t", F.explode(F.sequence(F.greatest(F.col("place") - (window - GRAM), F.lit(0)), F.col("place"))).alias("at"), F.lit(window).alias("n"))]
    for n in short:
        starts = windows.where(F.col("n") == n).select(F.split("win", " ").alias("w")).select(_grams("w", n).alias("g")).select(F.col("g")[0].alias("fp"))
        every = keyed.select("k", "t", "w").select("k", "t", F.posexplode_outer(F.when(F.size("w") >= n, _grams("w", n))).alias("at", "fp"))
        places.append(every.join(_small(starts, n_windows), "fp", "left_semi").select("k", "t", "at", F.lit(n).alias("n")))
    found = reduce(DataFrame.union, places).groupBy("k", "t").agg(F.collect_set(F.struct("at", "n")).alias("found"))
    found = materialize(found, "hits")
    # Texts, not words, are dealt out, and by the same join at every size; repeated rows fall together below.
    texts = base.select("k", "t", "text").join(found.hint("merge"), ["k", "t"]).select("k", "t", "found", words(F.col("text")).alias("w"))
    tried = texts.select("k", "t", F.size("w").alias("size"), F.explode_outer(F.expr("transform(found, f -> named_struct('at', f.at, 'n', f.n, 'win', array_join(slice(w, f.at + 1, f.n), ' ')))")).alias("f"))
    tried = tried.select("k", "t", "f.at", "f.n", "f.win").where("at + n <= size")
    exact = tried.join(_small(windows.withColumnRenamed("n", "m"), n_windows), "win").where("n = m").select("k", "t", "at", "n", "items")
    exact = materialize(exact, "exact")
    covered = exact.select("k", "t", F.explode(F.expr("sequence(at, at + n - 1)")).alias("p")).distinct().groupBy("k", "t").agg(F.count("*").alias("n_hit"))
    named = exact.select("k", "t", "items").distinct().groupBy("k", "t").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    result = covered.join(named, ["k", "t"])
    sized = base.select("doc_id", "k", "t", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(result, ["k", "t"], "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("t").alias("text_hash"),
    )
