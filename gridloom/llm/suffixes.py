"""Repeated passages by a difference-cover suffix sort.

Positions of every document are sampled by a difference cover: for any two positions some equal step
leads both to sampled ones, so two equal 400-byte strings hold two sampled suffixes, aligned alike,
that agree on their first 268 bytes.  The steps:

1. sampled suffixes are named by their first 268 bytes and sorted by name; unique names drop out;
2. recursion on names: samples of one name are sorted again by the name of all bytes that any string
   around them can reach (532 bytes); equal ones settle every string there at once;
3. the remaining suffixes (strings near the ends of a match) are merged in: their full 400-byte
   names are sorted;
4. equal neighbours in that order are the repeated strings.

Names are digests, since the removal needs equal strings only, not their order.  Texts stay in block
files in the shared folder; what is dealt to the sorts are arrays of names and places.  A block sends
a name that it repeats itself once, so no name gathers more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import filesystem, let_go, publish, shared_folder

LENGTH = 400
#: Bytes of text in a block, and bytes of names in a bucket of a sort, about.
BLOCK, BUCKET = 10_000_000, 8_000_000


def _orbit(first: int, factor: int, modulus: int) -> set[int]:
    out, x = set(), first
    while x not in out:
        out.add(x)
        x = factor * x % modulus
    return out


#: Perfect difference cover: every difference modulo 133 is met, each but 0 just once (12 of 133 positions).
PERIOD = 133
COVER = np.asarray(sorted(set().union(*(_orbit(k, 11, PERIOD) for k in (1, 8, 9, 69)))))
#: Bytes that a name and its surroundings keep of their digests; the bucket tells more bits.
NAME, AROUND = 5, 6
_ROW = "bucket long, block long, kind int, a binary, b binary, c binary"
_FIELDS = ["bucket", "block", "kind", "a", "b", "c"]
LOCAL, NAMES, ANSWER = 0, 1, 2
SINGLE, SETTLED, OPEN = 0, 1, 2


def _samples(lengths: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of all sampled positions of a block, in order."""
    short = length - PERIOD + 1
    docs, places = [], []
    for k, n in enumerate(lengths):
        if n >= length:
            p = (np.arange(0, n, PERIOD)[:, None] + COVER[None, :]).reshape(-1)
            p = p[p <= n - short]
            docs.append(np.full(len(p), k))
            places.append(p)
    return (np.concatenate(docs), np.concatenate(places)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each element, size of each group) by equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number)


def _firsts(number: np.ndarray) -> np.ndarray:
    """Mark of the first element of every group."""
    mark = np.zeros(len(number), bool)
    mark[np.unique(number, return_index=True)[1]] = True
    return mark


def _wide(raw: bytes, width: int) -> np.ndarray:
    """``width``-byte big-endian numbers as 64-bit ones."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def _u4(x) -> bytes:
    return np.asarray(x, "<u4").tobytes()


def _steps(refs: np.ndarray, flags: np.ndarray) -> bytes:
    """Ascending places as steps, byte plane by byte plane, and their flags: mostly zeros, which compress away."""
    steps = np.diff(refs, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.concatenate([steps.T.reshape(-1), flags.astype(np.uint8)]).tobytes()


def _unsteps(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").reshape(-1), dtype=np.int64), planes[4]


def _mark(block_starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int, total: int) -> np.ndarray:
    """Flags over a block's bytes: where a string that reaches one of the samples can start."""
    lo = np.maximum(places - (PERIOD - 1), 0) + block_starts[docs]
    hi = np.minimum(places, lengths[docs] - length) + block_starts[docs]
    ok = hi >= lo
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, lo[ok], 1)
    np.add.at(step, hi[ok] + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _edges(flags: np.ndarray) -> bytes:
    """Flags as the bounds of their runs."""
    return _u4(np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))))


def _between(edges: bytes, total: int) -> np.ndarray:
    at = np.frombuffer(edges, "<u4").astype(np.int64)
    step = np.zeros(total + 1, np.int8)
    step[at[0::2]] += 1
    step[at[1::2]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _FIELDS)


def _dealt(block: int, buckets: int, names: np.ndarray, other: np.ndarray, width: tuple[int, int], refs: np.ndarray, flags: np.ndarray) -> Iterator[tuple]:
    """Rows of names, one for each bucket; ``refs`` ascend."""
    bucket = ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            yield (k, block, NAMES, _narrow(names[at], width[0]), _narrow(other[at], width[1]), _steps(refs[at], flags[at]))


def _sample_blocks(folder: str, buckets: int, length: int, block_bytes: int):
    """Step 1 in the blocks: write the texts of a block, name its samples, settle what repeats inside."""
    short = length - PERIOD + 1

    def block_rows(block: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = [b"" if t is None else t for t in held.column("text").to_pylist()]

        def write(out):
            with pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(held)

        publish(folder, f"block-{block}.arrow", write)
        docs, places = _samples([len(t) for t in texts], length)
        names, wide = [], []
        at = 0
        for k, t in enumerate(texts):
            n = int(np.searchsorted(docs, k, "right")) - at
            own = places[at : at + n].tolist()
            names.append(b"".join([xxhash.xxh3_64_digest(t[p : p + short]) for p in own]))
            wide.append(b"".join([xxhash.xxh3_64_digest(t[max(p - PERIOD + 1, 0) : p + length], seed=min(p, PERIOD - 1)) for p in own]))
            at += n
        name = np.frombuffer(b"".join(names), ">u8").astype(np.uint64)
        ctx = np.frombuffer(b"".join(wide), ">u8").astype(np.uint64) & np.uint64((1 << 8 * AROUND) - 1)
        by_name, sizes = _groups(name)
        by_ctx, alike = _groups(name, ctx)
        known = sizes[by_name] > 1
        settled = alike[by_ctx] > 1
        still = known & ~settled
        first = settled & _firsts(by_ctx)
        has_open = np.zeros(len(sizes), bool)
        has_open[by_name[still]] = True
        repeat = first & has_open[by_name]
        proxy = still & _firsts(np.where(still, by_name, -1 - np.arange(len(name))))
        send = np.flatnonzero(~known | first | proxy)
        flag = np.select([~known[send], first[send]], [SINGLE, SETTLED], OPEN)
        local = (block % buckets, block, LOCAL, _u4(np.flatnonzero(settled)), _u4(np.flatnonzero(still | repeat)), b"")
        rows = [local, *_dealt(block, buckets, name[send], ctx[send], (NAME, AROUND), send, flag)]
        for k in range(0, len(rows), 64):
            yield _rows(rows[k : k + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        part, seq = TaskContext.get().partitionId(), 0
        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0)))
            at = 0
            while at < batch.num_rows:
                # As many rows as the block still takes, at least one.
                n = max(1, int(np.searchsorted(ends[at:], (ends[at - 1] if at else 0) + block_bytes - size, "left")) + 1)
                parts.append(batch.slice(at, n))
                size += int(ends[min(at + n, batch.num_rows) - 1] - (ends[at - 1] if at else 0))
                at += n
                if size >= block_bytes:
                    yield from block_rows((part << 20) + seq, pa.Table.from_batches(parts))
                    parts, size, seq = [], 0, seq + 1
        if parts:
            yield from block_rows((part << 20) + seq, pa.Table.from_batches(parts))

    return run


def _through(group: pd.DataFrame) -> list[tuple]:
    return [(0, int(r.block), LOCAL, r.a, r.b, r.c) for r in group[group["kind"] == LOCAL].itertuples()]


def _gathered(group: pd.DataFrame, width: int, other: int):
    rows = group[group["kind"] == NAMES].sort_values("block")
    raw = lambda c: b"".join(rows[c])
    refs, flags = (np.concatenate(x) for x in zip(*map(_unsteps, rows["c"])))
    owner = np.repeat(rows["block"].to_numpy(), [len(c) // 5 for c in rows["c"]])
    return _wide(raw("a"), width), _wide(raw("b"), other), refs, flags, owner


def _answers(owner: np.ndarray, *marks: np.ndarray, refs: np.ndarray) -> list[tuple]:
    out = []
    for block in np.unique(owner[np.any(marks, axis=0)]):
        own = owner == block
        out.append((0, int(block), ANSWER, *(_u4(refs[own & m]) for m in marks), *[b""] * (3 - len(marks))))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FIELDS)


def _sort_names(group: pd.DataFrame) -> pd.DataFrame:
    """Steps 1 and 2 over one bucket: names met twice, and among them the equal surroundings."""
    rows = _through(group)
    if (group["kind"] == NAMES).any():
        name, ctx, refs, flag, owner = _gathered(group, NAME, AROUND)
        by_name, sizes = _groups(name)
        by_ctx, alike = _groups(name, ctx)
        known = (sizes[by_name] > 1) | (flag != SINGLE)
        sure = np.zeros(len(alike), bool)
        sure[by_ctx[flag == SETTLED]] = True
        settled = (alike[by_ctx] > 1) & (flag != OPEN) | sure[by_ctx] & (flag != OPEN)
        # An open proxy does not make its own surroundings repeated, but a single like it is.
        still = known & ~settled
        has_open = np.zeros(len(sizes), bool)
        has_open[by_name[still]] = True
        first = settled & _firsts(np.where(settled, by_ctx, -1 - np.arange(len(name))))
        emit = (still & (flag == SINGLE)) | (first & has_open[by_name])
        rows += _answers(owner, settled & (flag == SINGLE), emit, refs=refs)
    return _frame(rows)


def _load(folder: str, block: int) -> tuple[pa.Table, list[bytes]]:
    """Rows of a block file, and their texts."""
    store, path = filesystem(folder)
    with store.open_input_stream(f"{path}/block-{block}.arrow") as f:
        held = pa.ipc.open_stream(f).read_all()
    return held, [b"" if t is None else t for t in held.column("text").to_pylist()]


def _merge_rest(folder: str, buckets: int, length: int):
    """Step 3 in the blocks: settled strings are marked, the others around open samples get their full names."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        _, texts = _load(folder, block)
        lengths = np.asarray([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        docs, places = _samples(lengths.tolist(), length)
        number = lambda c: np.unique(np.frombuffer(b"".join(group[c]), "<u4"))
        done, emit = number("a"), number("b")
        dup = _mark(starts, lengths, docs[done], places[done], length, total)
        around = _mark(starts, lengths, docs[emit], places[emit], length, total)
        wanted = np.flatnonzero(around)
        owner = np.searchsorted(starts, wanted, "right") - 1
        digests, at = [], 0
        for k, n in zip(*np.unique(owner, return_counts=True)):
            t = texts[k]
            digests.append(b"".join([xxhash.xxh3_128_digest(t[p : p + length]) for p in (wanted[at : at + n] - starts[k]).tolist()]))
            at += int(n)
        pair = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        high, low = pair[:, 0], pair[:, 1] & np.uint64((1 << 32) - 1)
        by, sizes = _groups(high, low)
        again = sizes[by] > 1
        dup[wanted[again]] = True
        send = np.flatnonzero(~again | _firsts(by))
        answered = dup[wanted[send]]
        rows = [(block % buckets, block, LOCAL, _edges(dup), _edges(around), b"")]
        rows += _dealt(block, buckets, high[send], low[send], (8, 4), send, answered)
        return _frame(rows)

    return run


def _sort_rest(group: pd.DataFrame) -> pd.DataFrame:
    """Step 4 over one bucket: full names that meet again."""
    rows = _through(group)
    if (group["kind"] == NAMES).any():
        high, low, refs, flag, owner = _gathered(group, 8, 4)
        by, sizes = _groups(high, low)
        rows += _answers(owner, (sizes[by] > 1) & (flag == 0), refs=refs)
    return _frame(rows)


def _remove(folder: str, length: int, keep: list[str]):
    """The covered bytes of each document of a block go."""

    def run(group: pa.Table) -> pa.Table:
        group = group.to_pandas()
        held, texts = _load(folder, int(group["block"].iloc[0]))
        lengths = np.asarray([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        local = group[group["kind"] == LOCAL].iloc[0]
        dup, wanted = _between(local["a"], total), np.flatnonzero(_between(local["b"], total))
        dup[wanted[np.frombuffer(b"".join(group.loc[group["kind"] == ANSWER, "a"]), "<u4")]] = True
        cover = np.zeros(total + 1, np.int32)
        at = np.flatnonzero(dup)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed, spans, kept = [], [], []
        for k, t in enumerate(texts):
            own = gone[starts[k] : starts[k] + lengths[k]]
            n = int(own.sum())
            removed.append(n)
            kept.append(np.frombuffer(t, np.uint8)[~own].tobytes() if n else t)
            spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0]) if n else 0)
        added = [pa.array(lengths), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        return pa.table([*(held.column(c) for c in keep), *added], [*keep, *RESULT])

    return run


RESULT = ["n_bytes", "n_removed", "n_spans", "kept"]


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK, bucket_bytes: int = BUCKET) -> DataFrame:
    """The other columns of ``docs``, and n_bytes, n_removed, n_spans and kept (the remaining bytes of ``text``) of every row.

    Each byte that lies in a ``length``-byte string which also starts anywhere else, in the same or
    another document, is removed; strings are judged on the input.  Matches never cross documents.
    Null texts are empty; repeated rows are documents of their own and remove each other; columns
    named like a result give way to it.
    """
    if length < PERIOD + 32:
        raise ValueError(f"strings have at least {PERIOD + 32} bytes")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total * len(COVER) / PERIOD * 12 / bucket_bytes))
    folder = shared_folder(spark, "blocks")
    keep = [c for c in docs.columns if c != "text" and c not in RESULT]
    rows = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    sampled = rows.mapInArrow(_sample_blocks(folder, buckets, length, block_bytes), _ROW)
    named = sampled.groupBy("bucket").applyInPandas(_sort_names, _ROW)
    merged = named.groupBy("block").applyInPandas(_merge_rest(folder, buckets, length), _ROW)
    found = merged.groupBy("bucket").applyInPandas(_sort_rest, _ROW)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in RESULT[:3]), T.StructField("kept", T.BinaryType())])
    return found.groupBy("block").applyInArrow(_remove(folder, length, keep), schema)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) of each text, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
