"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Whole windows of a document are sequences of their own.  The rests are dealt to shards by the ids
they have in common (a weighted min-hash of their rarer tokens, so like goes with like), each shard
holds an inverted index of its rests with corpus-wide BM25 weights, and greedy windows are filled
with the unused neighbours of their seed: by all its terms, but in its own shard only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let_go, shared_folder, slices
from gridloom.llm.token_store import END_ID, encoder

WINDOW = 1024
#: Ids that one inverted index holds; a task works through as many as it is dealt.
SHARD_IDS = 1_500_000
#: Terms in at least one of so many rests have a dense row of weights; the others have posting lists.
DENSE = 8
K1, B = 1.2, 0.75
_COLUMNS = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", "first", "second"]
_SCHEMA = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary, first long, second long"


def _pieces(tokenizer: str, window: int, added: bool = False):
    """Rows of whole windows (without ids), of rests (with ids), and one row of document frequencies for each task (length null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, added), np.asarray([END_ID], "<u4").tobytes()
        df = np.zeros(enc.library.get_vocab_size(), np.int64)
        last = np.zeros(len(df), np.int64)
        one, two = route_keys(len(df))
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = enc.encode(text) + end
                ids = np.frombuffer(raw, "<u4")
                place = np.arange(len(ids))
                last[ids] = place
                df[ids[last[ids] == place]] += 1  # each distinct id once
                n, whole = len(ids), len(ids) // window * window
                rows += [(doc, n, a, window, zlib.crc32(raw[4 * a : 4 * (a + window)]), None, None, None) for a in range(0, whole, window)]
                if n > whole:
                    rest = ids[whole:]
                    rows.append((doc, n, whole, n - whole, zlib.crc32(raw[4 * whole :]), raw[4 * whole :], int(rest[one[rest].argmin()]), int(rest[two[rest].argmin()])))
            if rows:
                yield _batch(rows)
        if df.any():
            yield _batch([(None, None, None, None, None, df.astype("<i8").tobytes(), None, None)])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(columns))], _COLUMNS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_py(), "<i8")
            total = own.copy() if total is None else total + own
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])


def inverse_frequency(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)


def route_keys(size: int) -> list[np.ndarray]:
    """Two weighted min-hashes over the vocabulary: rests that share rare tokens tend to share their winners.

    A token wins with a chance in proportion to its weight; later merges of the vocabulary are rarer
    and weigh more, so rests can be routed before the corpus is counted.
    """
    token = np.arange(size, dtype=np.uint64)
    weight = np.log2(np.arange(size) + 2.0) ** 4
    drawn = lambda salt: (((token + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return [(-np.log(drawn(salt) + 1e-18) / weight).astype(np.float32) for salt in (1, 10_007)]


class Shard:
    """Inverted index of rests, and the greedy filling of windows from it."""

    def __init__(self, rests: list[tuple], idf: np.ndarray, mean: float, window: int) -> None:
        self.rests, self.window = rests, window
        self.length = np.asarray([len(r[3]) for r in rests])
        terms, counts = zip(*(np.unique(r[3], return_counts=True) for r in rests))
        doc = np.repeat(np.arange(len(rests)), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        norm = (K1 * (1 - B + B * self.length / mean)).astype(np.float32)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.query = terms
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.weight = term[order], doc[order], weight[order]
        self.free = np.ones(len(rests), bool)
        self.at = np.arange(len(rests))
        self._index(len(idf))

    def _index(self, size: int) -> None:
        """Dense rows of the common terms and posting lists of the others, over the rests in ``at``."""
        self.first = np.searchsorted(self.term, np.arange(size + 1))
        common = np.flatnonzero(np.diff(self.first) * DENSE >= len(self.at))
        self.row = np.full(size, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.at)), np.float32)
        for k, t in enumerate(common.tolist()):
            here = slice(self.first[t], self.first[t + 1])
            self.dense[k, self.doc[here]] = self.weight[here]

    def _compact(self) -> None:
        """Leave used rests out of the index."""
        kept = self.free[self.at]
        own = kept[self.doc]
        self.doc = (np.cumsum(kept) - 1)[self.doc[own]]
        self.term, self.weight, self.at = self.term[own], self.weight[own], self.at[kept]
        self._index(len(self.row))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused rests that share any term with the seed, best first; ties in the order of the shard."""
        if 2 * np.count_nonzero(self.free[self.at]) < len(self.at):
            self._compact()
        query = self.query[seed]
        row = self.row[query]
        score = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64)
        spans = [slice(a, b) for a, b in zip(self.first[query[row < 0]].tolist(), self.first[query[row < 0] + 1].tolist()) if a < b]
        if spans:
            score += np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), len(self.at))
        score[~self.free[self.at]] = 0
        found = np.flatnonzero(score)
        return self.at[found[np.argsort(-score[found], kind="stable")]]

    def fill(self) -> Iterator[list[tuple]]:
        """Windows as lists of (rest, first id, length); the last one may be short.

        A neighbour that does not fit is cut; what is left of it is the next seed.  Where no
        neighbour is left the next rests of the shard's order follow.
        """
        nxt, left = 0, None
        seed = -1
        while True:
            window: list[tuple] = []
            room = self.window
            if left is not None:
                seed, at = left
                left = None
            else:
                while nxt < len(self.rests) and not self.free[nxt]:
                    nxt += 1
                if nxt == len(self.rests):
                    return
                seed, at = nxt, 0
                self.free[seed] = False
            take = min(room, int(self.length[seed]) - at)
            window.append((seed, at, take))
            room -= take
            if at + take < self.length[seed]:
                left = (seed, at + take)
            if room:
                for k in self.neighbours(seed).tolist():
                    self.free[k] = False
                    take = min(room, int(self.length[k]))
                    window.append((k, 0, take))
                    room -= take
                    if take < self.length[k]:
                        left = (k, take)
                    if not room:
                        break
            while room:
                while nxt < len(self.rests) and not self.free[nxt]:
                    nxt += 1
                if nxt == len(self.rests):
                    break
                self.free[nxt] = False
                take = min(room, int(self.length[nxt]))
                window.append((nxt, 0, take))
                room -= take
                if take < self.length[nxt]:
                    left = (nxt, take)
            yield window


def _pack(idf, mean: float, window: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()  # all ids are written
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush(last: bool):
            nonlocal seq, held, size
            shard = Shard(held, idf.value, mean, window)
            rests, rows, short = held, [], []
            held, size = [], 0
            for filled in shard.fill():
                if not last and sum(n for _, _, n in filled) < window:
                    short += [(*rests[k][:2], rests[k][2] + at, rests[k][3][at : at + n]) for k, at, n in filled]  # goes on into the next index
                    continue
                offset = 0
                for k, at, n in filled:
                    doc, tokens, start, ids = rests[k]
                    rows.append((doc, start + at, n, zlib.crc32(ids[at : at + n].tobytes()), tokens, ((part << 32) + seq) * 2 + 1, offset))
                    offset += n
                seq += 1
            held, size = short, sum(len(r[3]) for r in short)
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES)

        for batch in batches:
            doc, tokens, start = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for k, x in enumerate(batch.column(5)):
                ids = np.frombuffer(x.as_py(), "<u4")
                held.append((doc[k], tokens[k], start[k], ids))
                size += len(ids)
                if size >= shard_ids:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_ids: int = SHARD_IDS, added: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text; others are ignored) in sequences of at most ``window`` ids.

    Each document is its ids and then the end id; null and empty texts are the end id alone.  Every
    id lies in one piece; pieces of a sequence follow each other from offset 0.  Only the last
    sequence of a task can be shorter than the window.  Repeated rows are packed once each; an empty
    table gives no piece.  ``added`` reads the file's added tokens as such.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "pieces")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, window, added), _SCHEMA).write.parquet(path)
    rows = spark.read.schema(_SCHEMA).parquet(path)
    found = rows.where("length is null").select("ids").mapInArrow(_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # a row per token of the vocabulary at most
    documents, tokens, rest_ids = rows.where("length is not null").agg(
        F.sum((F.col("start") == 0).cast("long")), F.sum("length"), F.sum(F.when(F.col("ids").isNotNull(), F.col("length")))
    ).first()
    if not documents:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in PIECES))
    df = np.zeros(int(found["token"].max()) + 1, np.int64)
    df[found["token"].to_numpy()] = found["n"].to_numpy()
    idf = spark.sparkContext.broadcast(inverse_frequency(df, documents))
    whole = rows.where("length is not null and ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rests = rows.where("length is not null and ids is not null")
    shards = max(1, math.ceil((rest_ids or 0) / shard_ids))
    dealt = rests.repartitionByRange(shards, "first", "second", "doc_id")
    dealt = dealt.sortWithinPartitions("first", "second", "doc_id", "start", "ids_crc32").select(*_COLUMNS[:6])
    mean = tokens / documents
    packed = dealt.mapInArrow(_pack(idf, mean, window, shard_ids), ", ".join(f"{c} long" for c in PIECES))
    return whole.union(packed)
