"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import held_out, kept, let_go

UNDETERMINED = "und"
#: Labelled documents of each language that a model is fitted on, about (chosen by a hash of the id).
FIT_DOCS = 4000
#: Words of a language, and n-grams of a language and length, that a model keeps.
KEEP_WORDS, KEEP_GRAMS = 20_000, 4_000
ORDERS = (5, 4, 3, 2, 1)
#: Words after which more words no longer sharpen the score.
SHARP = 12
#: A letter, then letters and the marks that combine with them; numeric signs are no letters.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Bytes, about, of the words that a task keeps scored, and words of a text that are looked up together.
MEMO_BYTES, CHUNK = 48 << 20, 50_000
#: N-grams of a word cut out of it in one row.
GRAMS_A_ROW = 4096


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + order] for k in range(len(marked) - order + 1)]


def _place(seed: int | None = None) -> Column:
    """A number from 0 to 1 fixed by the row's id; 0 without one."""
    parts = [F.col("doc_id").cast("string")] + ([F.lit(seed)] if seed is not None else [])
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _term_counts(sample: DataFrame, subsets: int) -> DataFrame:
    """Rows (lang, kind, term, n0, n1, ...): words (kind 0) and n-grams (kind: length) of ``sample`` (lang, text, bits) in each subset."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found: dict[tuple, Counter] = {}
            for lang, text, bits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found.setdefault((lang, bits), Counter()).update(words(text))
            for (lang, bits), seen in found.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(seen), "term": list(seen), "bits": [bits] * len(seen), "n": list(seen.values())})

    counted = sample.select("lang", "text", "bits").mapInArrow(count, "lang string, term string, bits long, n long")
    sums = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(subsets)]
    names = [f"n{k}" for k in range(subsets)]
    terms = counted.groupBy("lang", "term").agg(*sums)
    marked = terms.select("lang", F.concat(F.lit("<"), "term", F.lit(">")).alias("word"), *names)
    cut = marked.select("*", F.explode(F.filter(F.array(*map(F.lit, ORDERS)), lambda o: o <= F.length("word"))).alias("kind"))
    cut = cut.withColumn("last", F.length("word") - F.col("kind") + 1)
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(GRAMS_A_ROW))).alias("first"))
    places = F.sequence(F.col("first"), F.least("last", F.col("first") + F.lit(GRAMS_A_ROW - 1)))
    cut = cut.select("lang", "kind", F.explode(F.transform(places, lambda p: F.substring(F.col("word"), p, F.col("kind")))).alias("term"), *names)
    grouped = cut.groupBy("lang", "kind", "term").agg(*[F.sum(n).alias(n) for n in names])
    return terms.select("lang", F.lit(0).alias("kind"), "term", *names).unionByName(grouped)


def _model(kept: pd.DataFrame) -> dict:
    """Log frequencies as one matrix for each kind of term, with the rows of its terms."""
    langs = sorted(kept["lang"].unique())
    index = {lang: k for k, lang in enumerate(langs)}
    totals = {(r.lang, r.kind): r.all for r in kept.drop_duplicates(["lang", "kind"]).itertuples()}
    rows, tables = {}, {}
    floors = np.zeros(len(langs), np.float32)
    for kind in (0, *ORDERS):
        own = kept[kept["kind"] == kind]
        at, terms = pd.factorize(own["term"])
        counts = np.zeros((len(terms), len(langs)))
        counts[at, own["lang"].map(index).to_numpy(int)] = own["n"]
        below = np.asarray([totals.get((lang, kind), 0) + 0.5 * len(own) for lang in langs])
        rows[kind] = {term: k for k, term in enumerate(terms)}
        tables[kind] = np.log((counts + 0.5) / np.maximum(below, 1e-9)).astype(np.float32)
        if kind == 0:
            floors = np.log(0.5 / np.maximum(below, 1e-9)).astype(np.float32)
    return {"langs": langs, "rows": rows, "tables": tables, "floors": floors}


def fit_subsets(labelled: DataFrame, subsets: list[Column], fit_docs: int = FIT_DOCS) -> list[dict]:
    """One model for each condition of ``subsets`` on the labelled rows; texts are read and counted once for all.

    A null condition counts as false; see :func:`fit`.
    """
    rows = labelled.where("lang is not null and text is not null")
    own = [F.coalesce(s, F.lit(False)) for s in subsets]
    rows = rows.select("doc_id", "text", "lang", *[s.alias(f"in{k}") for k, s in enumerate(own)])
    shares = rows.groupBy("lang").agg(*[F.count(F.when(F.col(f"in{k}"), 1)).alias(f"all{k}") for k in range(len(own))])
    rows = rows.join(F.broadcast(shares), "lang")  # one row per language
    bits = [F.when(F.col(f"in{k}") & (_place() < F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col(f"all{k}"))), 1 << k).otherwise(0) for k in range(len(own))]
    sample = rows.withColumn("bits", sum(bits[1:], bits[0])).where("bits > 0")
    terms = _term_counts(sample, len(own))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("subset"), F.col(f"n{k}").alias("n")) for k in range(len(own))]))
    terms = terms.select("lang", "kind", "term", each.alias("e")).select("lang", "kind", "term", "e.subset", "e.n").where("n > 0")
    # Ranked over the terms of a bounded sample.
    group = Window.partitionBy("subset", "lang", "kind")
    kept = terms.withColumn("all", F.sum("n").over(group)).withColumn("r", F.row_number().over(group.orderBy(F.desc("n"), "term")))
    kept = kept.where(F.col("r") <= F.when(F.col("kind") == 0, KEEP_WORDS).otherwise(KEEP_GRAMS))
    kept = kept.select("subset", "lang", "kind", "term", "n", "all").toPandas()
    return [_model(kept[kept["subset"] == k]) for k in range(len(own))]


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> dict:
    """Model of labelled rows (doc_id, text, lang): log frequencies of words and n-grams per language.

    Languages are the non-null values of ``lang`` with any word.  About ``fit_docs`` rows of each
    language are read, those with the least hash of their id; tables are cut to the most frequent
    entries, so the model's size is bounded whatever the input.  Repeated rows count as often as
    they occur.
    """
    return fit_subsets(labelled, [F.lit(True)], fit_docs)[0]


def fit_with_floor(labelled: DataFrame, parts: int = 8, share: float = 0.001) -> tuple[dict, float]:
    """Model of all labelled rows, and the least share of known letters of a text in a learned language.

    For the share, a model of the rows outside one of ``parts`` judges all those inside: all but ``share`` of them reach it, and it is never above half their
    median.  0 where no row can be judged.
    """
    marked = labelled.where("lang is not null and text is not null")
    inside = held_out("doc_id", parts)
    model, outside = fit_subsets(marked, [F.lit(True), ~inside])
    judged = identify(marked.where(inside), outside, known=True).where(F.col("lang_pred") != UNDETERMINED)
    found = judged.agg(F.percentile_approx("known", [share, 0.5], 10_000)).first()[0]
    return model, min(found[0], found[1] / 2) if found else 0.0


class Scorer:
    """Scores of texts; words met are kept as rows of one matrix, up to ``MEMO_BYTES``."""

    def __init__(self, model: dict, known: bool = False) -> None:
        self.langs, self.rows, self.tables, self.known = model["langs"], model["rows"], model["tables"], known
        self.learned = self.tables[0] > model["floors"] + 0.5
        self.memo: dict[str, int] = {}
        self.held = 0
        self.matrix = np.zeros((1024, len(self.langs) * (2 if known else 1)), np.float32)

    def vectors(self, new: list[str]) -> np.ndarray:
        """Rows of words not met yet: log frequencies for each language, then the letters in learned words if ``known``."""
        size = len(self.langs)
        out = np.zeros((len(new), self.matrix.shape[1]), np.float32)
        at = np.array([self.rows[0].get(w, -1) for w in new])
        learned = np.flatnonzero(at >= 0)
        out[learned, :size] = self.tables[0][at[learned]]
        if self.known:
            out[learned, size:] = np.array([len(new[k]) for k in learned])[:, None] * self.learned[at[learned]]
        found: dict[int, tuple[list, list, list]] = {order: ([], [], []) for order in ORDERS}
        for k in np.flatnonzero(at < 0).tolist():
            marked = f"<{new[k]}>"
            for order in ORDERS:
                own = self.rows[order]
                ids = [own[g] for j in range(len(marked) - order + 1) if (g := marked[j : j + order]) in own]
                if ids:
                    words_, starts, grams_ = found[order]
                    words_.append(k)
                    starts.append(len(grams_))
                    grams_.extend(ids)
                    break
        for order, (words_, starts, grams_) in found.items():
            if words_:
                sums = np.add.reduceat(self.tables[order][grams_], starts, axis=0)
                out[words_, :size] = sums / np.diff([*starts, len(grams_)])[:, None]
        return out

    def add(self, new: list[str]) -> None:
        first = len(self.memo)
        while first + len(new) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[first : first + len(new)] = self.vectors(new)
        self.memo.update(zip(new, range(first, first + len(new))))
        self.held += sum(160 + 4 * len(w) for w in new)

    def predict(self, text: str | None) -> tuple:
        """(language, score): the highest sum over all words; ties go to the first name.

        The score is the language's share of the exponentials of the mean word score times the
        number of words, at most ``SHARP``; it is at least one in the number of languages.  With
        ``known``, the share of the letters that lie in learned words of the language follows.
        """
        total, n, letters = np.zeros(self.matrix.shape[1]), 0, 0
        found = (m.group() for m in _WORD.finditer(text.lower())) if text and self.langs else iter(())
        while own := list(islice(found, CHUNK)):
            if self.held > MEMO_BYTES:
                self.memo, self.held, self.matrix = {}, 0, np.zeros((1024, self.matrix.shape[1]), np.float32)
            if new := list(dict.fromkeys(w for w in own if w not in self.memo)):
                self.add(new)
            total += self.matrix[list(map(self.memo.__getitem__, own))].sum(axis=0, dtype=np.float64)
            n += len(own)
            letters += sum(map(len, own)) if self.known else 0
        if not n:
            return (UNDETERMINED, 0.0, 0.0) if self.known else (UNDETERMINED, 0.0)
        score, known = total[: len(self.langs)], total[len(self.langs) :]
        best = int(np.argmax(score))
        away = (score - score[best]) / n * min(n, SHARP)
        out = self.langs[best], float(1 / np.exp(away).sum())
        return (*out, float(known[best] / letters)) if self.known else out


def identify(docs: DataFrame, model: dict, known: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any others) with lang_pred and score, and ``known`` if asked for; the whole text is read.

    ``und`` with score (and known) 0 where the text is null or has no letter, or nothing was learned.
    Repeated rows, and rows with a null id, are answered each by itself; columns of the names added are replaced.
    """
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(model)  # bounded by KEEP_WORDS and KEEP_GRAMS
    added = ["lang_pred", "score", "known"] if known else ["lang_pred", "score"]
    keep = [c for c in docs.columns if c not in added]
    out = docs.select(*keep)

    def run(texts: pd.Series) -> pd.DataFrame:
        scorer = kept(name, lambda: Scorer(shared.value, known))
        return pd.DataFrame([scorer.predict(t) for t in texts], columns=added)

    udf = F.pandas_udf(run, "lang_pred string, score double, known double" if known else "lang_pred string, score double")
    return out.withColumn("_found", udf(F.col("text"))).select(*keep, *(f"_found.{c}" for c in added))

