"""python -m tests.llm.packing_recall FOLDER ...: how much of a seed's brute-force BM25 neighbourhood its shard of op7 holds.

For 300 rests of each table: the ten best of all other rests by every term, and the shares of them
that lie in the rest's own shard, and that the 24 heaviest terms find there.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import packing
from gridloom.llm.common import table
from gridloom.llm.queries import tokenizer_path
from gridloom.session import session

SEEDS, BEST = 300, 10


def recall(spark, folder: str) -> tuple:
    """(rests, ids of rests, shards, share in the own shard, share found there by 24 terms)."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(packing._pieces(tokenizer_path(), packing.WINDOW), packing._SCHEMA).cache()
    held = rows.where("length is not null and ids is not null")
    total = held.agg(F.sum("length")).first()[0]
    shards = max(1, math.ceil(total / packing.SHARD_IDS))
    got = held.repartitionByRange(shards, "first", "second", "doc_id").select(F.spark_partition_id().alias("shard"), "ids").toArrow()
    documents, tokens = rows.where("length is not null").agg(F.sum((F.col("start") == 0).cast("long")), F.sum("length")).first()
    df = np.sum([np.frombuffer(r.ids, "<i8") for r in rows.where("length is null").collect()], axis=0)
    rows.unpersist()
    idf = packing.inverse_frequency(df, documents)
    shard, ids = got.column("shard").to_numpy(), [np.frombuffer(x.as_py(), "<u4") for x in got.column("ids")]
    rng = np.random.default_rng(1)
    seeds = rng.choice(len(ids), min(SEEDS, len(ids)), replace=False)
    score = np.zeros((len(seeds), len(ids)), np.float32)
    wanted = np.zeros((len(idf), len(seeds)), np.float32)
    norm = lambda n: packing.K1 * (1 - packing.B + packing.B * n / (tokens / documents))
    for k, seed in enumerate(seeds):
        wanted[np.unique(ids[seed]), k] = 1
    heavy = np.zeros_like(wanted)
    for k, seed in enumerate(seeds):
        t, tf = np.unique(ids[seed], return_counts=True)
        heavy[t[np.argsort(-idf[t] * tf / (tf + norm(len(ids[seed]))), kind="stable")[:24]], k] = 1
    short = np.zeros_like(score)
    for d, own in enumerate(ids):
        t, tf = np.unique(own, return_counts=True)
        w = (idf[t] * tf * (packing.K1 + 1) / (tf + norm(len(own)))).astype(np.float32)
        score[:, d], short[:, d] = w @ wanted[t], w @ heavy[t]
    inside = found = 0
    for k, seed in enumerate(seeds):
        score[k, seed] = short[k, seed] = -1
        best = np.argsort(-score[k], kind="stable")[:BEST]
        here = np.flatnonzero((shard == shard[seed]) & (short[k] > 0))
        inside += np.count_nonzero(shard[best] == shard[seed])
        found += len(np.intersect1d(best, here[np.argsort(-short[k, here], kind="stable")[:BEST]]))
    n = len(seeds) * min(BEST, len(ids) - 1)
    return len(ids), total, shards, inside / n, found / n


if __name__ == "__main__":
    spark = session("local[6]", 12)
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        print(folder, *recall(spark, folder), flush=True)
