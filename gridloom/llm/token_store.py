"""Token ids of documents, and a word-aligned binary file of them (Simple-8b).

File: magic ``S8BT``, a 32-byte header (version, documents, ids, blocks), then the sections

* document ids (int64) with a validity byte each, and id counts (uint32);
* per block of 256 ids: the index of its first word (uint32) - blocks decode independently;
* the 64-bit words, little-endian.

A word holds a selector in its low 4 bits and equal fields of ``60 // count`` bits above them.
Ids that need more than 60 bits cannot occur; ids of 21 to 32 bits take the widest selectors
(2 x 30, 1 x 60), which are the escapes of the format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import kept, publish, shared_folder, slices

BLOCK = 256
#: Values held by a word of selector 1, 2, ...
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
#: Bits that an id below 2^16 needs.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
MAGIC = b"S8BT"
VERSION = 1
END_ID = 0
#: Pieces and words kept in a worker's memory of encoded ones, characters of the longest, and pieces in one call of the library.
MEMO, LONGEST, CALL = 300_000, 64, 4096


# ------------------------------------------------------------------ tokenizing


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Byte-level BPE merges inside the pieces of its split pattern only, so a piece always gets the
    same ids; pieces met before are looked up, and the new ones of a text go to the library
    together.  A space before anything but white space always begins a piece, so texts are cut there
    first, and words met before need no pattern.  Texts with characters outside a plain range go to
    the library whole, so that no rule of character classes is restated here.  With ``added`` the
    file's added tokens are read as their own ids, which is the library's default, and texts that
    hold one go to the library whole; without, they are spelled like other text.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not added:
            self.library.encode_special_tokens = True
        marks = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(map(re.escape, marks))).search if marks else lambda text: None
        self.plain = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ſ‐-‧€]*").fullmatch
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+(?:_[^\s\w]*)*| ?_[^\s\w]*(?:_[^\s\w]*)*|\s+(?!\S)|\s+").findall
        self.begins = re.compile(r" (?=\S)").sub
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.plain(text) or self.added(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        loose = text[-1] == " " or "  " in text or " \n" in text or " \t" in text or " \r" in text
        words = (self.begins("\0 ", text) if loose else text.replace(" ", "\0 ")).split("\0")
        new = set(words).difference(self.memo)
        passing = self._learn(new) if new else []
        out = b"".join(map(self.memo.__getitem__, words))
        for word in passing:
            del self.memo[word]
        return out

    def _learn(self, words: set[str]) -> list[str]:
        """Put the ids of words into the memory; what it has no room for is named, to be dropped after the text.

        Words of several pieces are kept in the first half only, since their pieces are mostly known.
        """
        cut = {word: [word] if word[0:1] == " " and word[1:].isalpha() else self.pieces(word) for word in words}
        new = list({piece for pieces in cut.values() for piece in pieces}.difference(self.memo))
        room, passing = MEMO - len(self.memo), []
        for k in range(0, len(new), CALL):
            for piece, ids in self._called(new[k : k + CALL]):
                self.memo[piece] = ids
                if room > 0 and len(piece) < LONGEST:
                    room -= 1
                else:
                    passing.append(piece)
        for word, pieces in cut.items():
            if word not in self.memo:
                self.memo[word] = b"".join([self.memo[piece] for piece in pieces])
                if room > MEMO // 2 and len(word) < LONGEST:
                    room -= 1
                else:
                    passing.append(word)
        return passing

    def _called(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with their ids: those that begin with a space and go on are read as one text, which is cut at these spaces."""
        joined = [piece for piece in pieces if piece[0] == " " and not piece[1:2].isspace() and len(piece) > 1]
        if joined:
            found = self.library.encode("".join(joined), add_special_tokens=False)
            raw = np.asarray(found.ids, "<u4").tobytes()
            ends = [*(4 * np.flatnonzero(np.diff(found.word_ids)) + 4).tolist(), len(raw)]
            if len(ends) != len(joined):
                raise ValueError("the tokenizer's pieces are not those of its split pattern")
            yield from zip(joined, (raw[a:b] for a, b in zip([0, *ends], ends)))
        for piece in set(pieces).difference(joined) if len(joined) < len(pieces) else ():
            yield piece, np.asarray(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str, added: bool = False) -> Encoder:
    return kept((path, added), lambda: Encoder(path, added))


# ------------------------------------------------------------------ Simple-8b


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word): every block is packed on its own, all blocks side by side."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    full = np.zeros((blocks, BLOCK + 60), np.uint32)
    flat = np.zeros(blocks * BLOCK, np.uint32)
    flat[:n] = ids
    full[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = _BITS[full] if int(ids.max()) < len(_BITS) else np.frexp(full.astype(np.float64))[1].astype(np.uint8)
    # choice[b, i]: smallest selector whose values all fit from i on; fields behind the end hold 0.
    choice = np.full((blocks, BLOCK), len(COUNTS) - 1, np.uint8)
    top = bits
    span = 1
    for n_values in sorted(COUNTS)[1:]:
        while span * 2 <= n_values:
            top = np.maximum(top[:, : top.shape[1] - span], top[:, span:])
            span *= 2
        shift = n_values - span
        widest = np.maximum(top[:, :BLOCK], top[:, shift : shift + BLOCK]) if shift else top[:, :BLOCK]
        k = COUNTS.index(n_values)
        choice[widest <= WIDTHS[k]] = k
    # Where each block's words begin: one step in all blocks at a time.
    counts = np.asarray(COUNTS)
    choice = choice.reshape(-1)
    at = np.arange(blocks) * BLOCK
    end = at + BLOCK
    end[-1] = n
    begins = np.zeros(blocks * BLOCK, bool)
    while len(at):
        begins[at] = True
        at = at + counts[choice[at]]
        live = at < end
        at, end = at[live], end[live]
    place = np.flatnonzero(begins)
    kind = choice[place]
    words = kind.astype(np.uint64) + np.uint64(1)
    owner = place // BLOCK
    from_ = owner * (BLOCK + 60) + place % BLOCK
    full = full.reshape(-1)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        word, here = words[rows], from_[rows]
        for j in range(COUNTS[k]):
            word |= full[here + j].astype(np.uint64) << np.uint64(j * WIDTHS[k] + 4)
        words[rows] = word
    return words.astype("<u8"), np.searchsorted(owner, np.arange(blocks)).astype("<u4")


def decode_words(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Ids of all blocks: words of one selector are opened together and scattered to their places."""
    counts, widths = np.asarray((0, *COUNTS)), np.asarray((0, *WIDTHS))
    kind = (words & np.uint64(15)).astype(np.int64)
    if np.any((kind < 1) | (kind > len(COUNTS))):
        raise ValueError("unknown selector")
    held = counts[kind]
    before = np.cumsum(held) - held
    owner = np.zeros(len(words), np.int64)
    owner[first[1:]] = 1
    owner = np.cumsum(owner)
    start = before - before[first][owner] + owner * BLOCK
    out = np.zeros(-(-n // BLOCK) * BLOCK + 60, np.uint32)
    limit = np.minimum((owner + 1) * BLOCK, n)
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        c, w = int(counts[k]), int(widths[k])
        places = start[rows][:, None] + np.arange(c)
        values = (words[rows][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w) + np.uint64(4))) & np.uint64((1 << w) - 1)
        inside = places < limit[rows][:, None]
        out[places[inside]] = values[inside]
    return out[:n]


def pack_file(doc_ids: list, ids: list[bytes]) -> bytes:
    """One file of documents in the given order."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    words, first = encode_words(flat)
    return b"".join((
        MAGIC, struct.pack("<IQQQ", VERSION, len(doc_ids), len(flat), len(first)),
        np.asarray([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        np.asarray([len(x) // 4 for x in ids], "<u4").tobytes(), first.tobytes(), words.tobytes(),
    ))


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, id counts, ids) of one file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    version, docs, n, blocks = struct.unpack_from("<IQQQ", data, 4)
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at = 4 + struct.calcsize("<IQQQ")
    names = np.frombuffer(data, "<i8", docs, at)
    valid = data[at + 8 * docs : at + 9 * docs]
    at += 9 * docs
    counts = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    first = np.frombuffer(data, "<u4", blocks, at)
    at += 4 * blocks
    words = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
    return [int(d) if ok else None for d, ok in zip(names, valid)], counts, decode_words(words, first, n)


# ------------------------------------------------------------------ Spark


def write_tokens(docs: DataFrame, tokenizer: str, path: str, file_ids: int = 4_000_000, added: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and write token files in ascending order of doc_id.

    One row per file is returned: file, its place in the order, documents, ids.  Null ids come
    first; rows of one id are ordered by text; null or empty texts hold the end id alone; ``added``
    reads the file's added tokens as such (see ``Encoder``).  Rows are
    dealt by ranges, so a file is bounded by ``file_ids`` ids (or one document) whatever the input.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer, added), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", END_ID)
        names: list = []
        ids: list[bytes] = []
        size = 0

        def flush():
            name = f"tokens-{part:06d}-{seq:04d}.s8b"
            data = pack_file(names, ids)
            publish(path, name, lambda out: out.write(data))
            return pa.RecordBatch.from_pylist([{"file": name, "docs": len(names), "ids": size}], FILE_SCHEMA)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(doc)
                ids.append(enc.encode(text) + end)
                size += len(ids[-1]) // 4
                if size >= file_ids:
                    yield flush()
                    names, ids, size, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "file string, docs long, ids long")


FILE_SCHEMA = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def read_tokens(spark, path: str) -> DataFrame:
    """Documents of all token files below ``path``: file, place (in its file), doc_id, before (ids before it in its file), ids (binary uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, counts, ids = unpack_file(data.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4")
                for a in range(0, len(names), 512):
                    rows = range(a, min(a + 512, len(names)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([uri.rsplit("/", 1)[1]] * len(rows)), pa.array(rows, pa.int64()), pa.array([names[r] for r in rows], pa.int64()),
                        pa.array([int(ends[r] - counts[r]) for r in rows], pa.int64()), pa.array([raw[ends[r] - counts[r] : ends[r]].tobytes() for r in rows], pa.binary()),
                    ], ["file", "place", "doc_id", "before", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, place long, doc_id long, before long, ids binary")


def token_digests(spark, path: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document read back from the files.

    ``files`` (one row per file) gives each file's first id by a running sum over the file names.
    """
    from pyspark.sql import Window

    # One row per file of millions of ids: the running sum is over the list of files, not over documents.
    first = files.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("first"))
    rows = read_tokens(spark, path).select("file", "doc_id", "before", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(F.broadcast(first), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe them as read back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    report = shared_folder(spark, "token-files")
    write_tokens(docs, tokenizer, path, added=added).write.parquet(report)
    files = spark.read.schema("file string, docs long, ids long").parquet(report)
    if not files.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return token_digests(spark, path, files)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
