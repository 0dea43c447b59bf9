"""Spelling variants: words that differ in one code point, by a dictionary of trie-node pairs.

The words, sorted, number the nodes of their trie: a word adds a node for each prefix it does not
share with the word before it.  The reversed words number the trie of suffixes.  A place in a word
is then a pair of integers, the node of what is before it and the node of what follows.  Skipping
one code point and skipping none give the pairs; words whose pairs meet differ by a replaced code
point (both skip) or an inserted one (one skips).  As a pair fixes all but one code point, a pair
has no more words than the alphabet has letters, and one, so its words are counted and their most
frequent is found without listing pairs of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import materialize
from gridloom.llm.ordering import sorted_rows

#: The letters of a word.
LETTER = "[A-Za-zÀ-ÿ]"
#: Fewest code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One in so many (document, run) pairs loses a code point.
TYPO = 199
#: A word's form occurs at least so many times as often.
RATIO = 5
#: Words a task counts before it hands them on.
HELD = 300_000


def runs_of(text: str | None, least: int = LEAST_LENGTH) -> Counter:
    """Runs of at least ``least`` letters, A-Z lower-cased, with their number."""
    if not text:
        return Counter()
    return Counter(re.findall(f"{LETTER}{{{least},}}", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))


def spelled(doc_id: int | None, run: str) -> str:
    """The run as the document spells it: some lose one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches):
    held: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in runs_of(text).items():
                h = zlib.crc32(run.encode(), start)
                if h % TYPO:
                    held[run] += n
                elif len(run) > LEAST_LENGTH:
                    at = h % len(run)
                    held[run[:at] + run[at + 1 :]] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """word and n of every word of the documents (doc_id, text): at least ``LEAST_LENGTH`` code points, ``LEAST_COUNT`` occurrences."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _number(batches):
    """Trie nodes of sorted words, numbered from 1 in the task: ``path`` holds the node of each prefix."""
    last, path, made = "", [], 0
    for batch in batches:
        paths = []
        for word in batch["key"].to_pylist():
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            path = path[:same] + list(range(made + 1, made + 1 + len(word) - same))
            made += len(word) - same
            last = word
            paths.append(path)
        yield pa.record_batch([batch["word"], batch["key"], pa.array(paths, pa.list_(pa.int64()))], ["word", "key", "path"])


def trie(found: DataFrame, backwards: bool = False) -> DataFrame:
    """word and path, the numbers of the trie nodes of its prefixes (backwards: of its suffixes, the shortest first).

    Ranges of the sorted words number their nodes alone.  A range's first word then takes the nodes
    it shares from the last word of the range before, and the others move up by the nodes so far:
    one row for each range tells both.
    """
    spark = found.sparkSession
    keyed = found.select("word", (F.reverse("word") if backwards else F.col("word")).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key")
    own = materialize(own.mapInArrow(_number, "word string, key string, path array<long>").withColumn("part", F.spark_partition_id()), "trie")
    ends = own.groupBy("part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path"), F.max(F.array_max("path")).alias("made"),
    ).orderBy("part").collect()  # a row for each range
    moves, nodes, before, path = [], 0, "", []
    for e in ends:
        same = 0
        while same < min(len(e.first), len(before)) and e.first[same] == before[same]:
            same += 1
        shared, shift = path[:same], nodes - same
        moves.append((e.part, same, shared, shift))
        path = [shared[x - 1] if x <= same else x + shift for x in e.path]
        nodes, before = nodes + e.made - same, e.last
    moved = spark.createDataFrame(moves, "part int, same long, shared array<long>, shift long")
    # One row for each range of this job: bounded by the number of shuffle partitions.
    whole = own.join(F.broadcast(moved), "part")
    return whole.select("word", F.expr("transform(path, x -> IF(x <= same, element_at(shared, CAST(x AS INT)), x + shift))").alias("path"))


def node_pairs(found: DataFrame) -> DataFrame:
    """Pairs (p, s) of prefix node and suffix node of the words (word, n).

    ``skips`` tells whether a code point stands between them; ``own`` is false for all but the last
    place of a run of one letter, whose places give the same word when skipped.
    """
    both = found.join(trie(found).withColumnRenamed("path", "f"), "word").join(trie(found, backwards=True).withColumnRenamed("path", "r"), "word")
    both = both.select("word", "n", "f", "r", F.split("word", "").alias("c"), F.length("word").alias("l"))
    p = lambda i: f"IF({i} = 0, 0L, get(f, {i} - 1))"
    s = lambda i: f"IF({i} = l, 0L, get(r, l - ({i}) - 1))"
    skip = f"transform(sequence(0, l - 1), i -> named_struct('p', {p('i')}, 's', {s('i + 1')}, 'skips', true, 'own', i = l - 1 OR get(c, i) <> get(c, i + 1)))"
    stay = f"transform(sequence(0, l), i -> named_struct('p', {p('i')}, 's', {s('i')}, 'skips', false, 'own', false))"
    return both.select("word", "n", F.expr(f"inline(concat({skip}, {stay}))"))


def _follow(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last, by halving the way."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = materialize(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(found: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    Near are words one inserted, deleted or replaced code point apart.  The form is the near word of
    largest n (ties: the least in code-point order) if that is ``RATIO`` times the word's n or more;
    the root is the last of a chain of forms.  Words without near words stand alone.
    """
    pair = Window.partitionBy("p", "s")  # at most the letters of the alphabet and one
    rows = node_pairs(found).select(
        "word", "n", "skips", "own", F.count("*").over(pair).alias("all"), F.sum(F.col("skips").cast("long")).over(pair).alias("skipping"), F.sum(F.col("own").cast("long")).over(pair).alias("owning"),
        F.min(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("w"))).over(pair).alias("best"),
    ).where(F.col("all") > 1)
    stays = F.col("all") - F.col("skipping")  # a pair without a skip is one word
    near = F.when(F.col("skips"), F.col("skipping") - 1 + F.when(F.col("own"), stays).otherwise(0)).otherwise(F.col("owning"))
    # A pair's best word is the only one of it that can be five times as frequent as another.
    best = rows.groupBy("word").agg(F.sum(near).alias("n_near"), F.min(F.when(F.col("best.w") != F.col("word"), F.col("best"))).alias("best"))
    form = F.when(-F.col("best.minus") >= F.lit(RATIO) * F.col("n"), F.col("best"))
    named = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"))
    named = materialize(named.select("word", F.col("form.w").alias("form"), "n", "n_near", (-F.col("form.minus")).cast("long").alias("form_n")), "forms")
    roots = _follow(named.where("form IS NOT NULL")).withColumnRenamed("word", "_w")
    return named.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants of the words of documents (doc_id, text); see :func:`words` and :func:`variants`.

    Null and letterless texts have no words, a null id counts as the empty text, repeated rows count
    as often as they occur, runs may be of any length; other columns are not read.
    """
    return variants(materialize(words(docs), "words"))
