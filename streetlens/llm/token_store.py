"""Token files with Re-Pair grammar compression and random access.

Documents are range-partitioned by id; every partition is a part, cut into
blocks of a bounded number of ids. In a block frequent pairs of neighbouring
symbols are repeatedly replaced by nonterminals; a pair never spans two
documents, so each document is a run of symbols of its own. A block stores the
rules with the length of each nonterminal's expansion, the documents' symbol
and id counts, and the symbols bit-packed: a document is decoded alone by
expanding its symbols, and a position within it is found by summing lengths.

Block format (little-endian): magic ``SLRP``, uint32 version, uint64 counts of
documents, rules and symbols and the first nonterminal; then int64 ids, uint8
id-present flags, uint32 symbols and uint32 tokens per document; uint32 left,
uint32 right and uint32 expansion length per rule; uint16 low parts of the
symbols; uint8 number of bit planes and the packed planes of the high parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slim, tune
from .tokens import encoder

MAGIC, VERSION = b"SLRP", 1
#: Ids of a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Pairs replaced in a round, and how often a pair must occur to be worth a rule.
PAIRS, LEAST = 8192, 16
BUCKETS = 1 << 18
#: Symbols of a block, at most: the format has 24 bits for one.
SYMBOLS = 1 << 24


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - 18)) & np.int64(BUCKETS - 1)


def _places(pairs: np.ndarray, keys: np.ndarray, bucket: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, what): the positions of ``maybe`` whose key is one of the sorted ``pairs``, and which one.

    A bucket with one pair is a table look-up; the few with several are searched.
    """
    own = _bucket(pairs)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[own] = np.arange(len(pairs))
    shared = np.bincount(own, minlength=BUCKETS) > 1
    maybe = maybe[slot[bucket[maybe]] >= 0]
    found = keys[maybe]
    at = slot[bucket[maybe]].astype(np.int64)
    again = np.flatnonzero(shared[bucket[maybe]])
    at[again] = np.minimum(np.searchsorted(pairs, found[again]), len(pairs) - 1)
    hit = pairs[at] == found
    return maybe[hit], at[hit]


def repair(ids: np.ndarray, last: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right, lengths): ``ids`` with frequent pairs replaced; rule i makes
    ``first_free + i``, which expands to ``lengths[i]`` ids.

    ``last`` marks ids that end a document. Each round takes the most frequent
    pairs together; of overlapping occurrences every other one is replaced.
    Rounds go on until no pair occurs ``LEAST`` times.
    """
    seq, last = ids.astype(np.int64), last.copy()
    lefts, rights, free = [], [], first_free
    lengths = np.ones(first_free, np.int64)
    while len(seq) > 1 and free + PAIRS <= SYMBOLS:
        keys = seq[:-1] << 32 | seq[1:]
        bucket = _bucket(keys)
        bucket[last[:-1]] = BUCKETS
        counts = np.bincount(bucket, minlength=BUCKETS + 1)
        counts[BUCKETS] = 0
        able = counts >= LEAST
        maybe = np.flatnonzero(able[bucket])
        pairs, n = np.unique(keys[maybe], return_counts=True)
        top = np.argsort(-n, kind="stable")[:PAIRS]
        pairs = np.sort(pairs[top[n[top] >= LEAST]])
        if not len(pairs):
            break
        where, what = _places(pairs, keys, bucket, maybe)
        # runs of overlapping occurrences: keep every other one
        run = np.cumsum(np.concatenate([[True], np.diff(where) > 1])) - 1
        start = np.flatnonzero(np.concatenate([[True], np.diff(where) > 1]))
        take = (np.arange(len(where)) - start[run]) % 2 == 0
        where, what = where[take], what[take]
        seq[where] = free + what
        last[where] = last[where + 1]
        stay = np.ones(len(seq), bool)
        stay[where + 1] = False
        seq, last = seq[stay], last[stay]
        lefts.append(pairs >> 32)
        rights.append(pairs & 0xFFFFFFFF)
        lengths = np.concatenate([lengths, lengths[lefts[-1]] + lengths[rights[-1]]])
        free += len(pairs)
    none = [np.zeros(0, np.int64)]
    return seq, np.concatenate(lefts or none), np.concatenate(rights or none), lengths[first_free:]


def expansions(left: np.ndarray, right: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, ids) of the rules' expansions, ids one after another in the order of the rules."""
    lists: list[tuple] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        lists.append((lists[a - first_free] if a >= first_free else (a,)) + (lists[b - first_free] if b >= first_free else (b,)))
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for v in lists for x in v), np.int64, int(lengths.sum()))
    return lengths, flat


def write_block(doc_ids: list, arrays: list[np.ndarray], vocabulary: int) -> bytes:
    """The bytes of a block; ``arrays`` are the documents' ids (at least one each), all below ``vocabulary``."""
    tokens = np.array([len(a) for a in arrays], np.int64)
    flat = np.concatenate(arrays)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(tokens) - 1] = True
    symbols, left, right, lengths = repair(flat, last, vocabulary)
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= vocabulary
    size[rule] = lengths[symbols[rule] - vocabulary]
    ends = np.searchsorted(np.cumsum(size), np.cumsum(tokens)) + 1
    per_doc = np.diff(np.concatenate([[0], ends]))
    high = (symbols >> 16).astype(np.uint8)
    planes = int(high.max()).bit_length() if len(high) else 0
    parts = [
        MAGIC, struct.pack("<IQQQQ", VERSION, len(arrays), len(left), len(symbols), vocabulary),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), per_doc.astype("<u4").tobytes(), tokens.astype("<u4").tobytes(),
        left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), (symbols & 0xFFFF).astype("<u2").tobytes(),
        bytes([planes]), *(np.packbits(high >> p & 1).tobytes() for p in range(planes)),
    ]
    return b"".join(parts)


class Block:
    """A block for reading: ``docs`` documents, each decoded on its own."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        version, self.docs, rules, symbols, self.first = struct.unpack_from("<IQQQQ", data, 4)
        if version != VERSION:
            raise ValueError(f"token block version {version} is not known")
        at = 40

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = read("<i8", self.docs), read("u1", self.docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.symbol_ends, self.tokens = np.cumsum(read("<u4", self.docs), dtype=np.int64), read("<u4", self.docs).astype(np.int64)
        left, right, self.lengths = read("<u4", rules).astype(np.int64), read("<u4", rules).astype(np.int64), read("<u4", rules).astype(np.int64)
        self.symbols = read("<u2", symbols).astype(np.int64)
        for p in range(int(read("u1", 1)[0])):
            self.symbols |= np.unpackbits(read("u1", (symbols + 7) // 8))[:symbols].astype(np.int64) << (16 + p)
        _, flat = expansions(left, right, self.first)
        # every symbol's expansion lies in ``self.flat`` from ``self.begin``: terminals are looked up as they are
        self.begin, self.flat = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64), flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.first
        size = np.ones(len(symbols), np.int64)
        size[rule] = self.lengths[symbols[rule] - self.first]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[start[~rule]] = symbols[~rule]
        n, begin, to = size[rule], self.begin[symbols[rule] - self.first], start[rule]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(begin, n) + step]
        return out

    def document(self, i: int) -> np.ndarray:
        """The ids (uint32) of document ``i`` of the block."""
        a, b = (self.symbol_ends[i - 1] if i else 0), self.symbol_ends[i]
        return self.expand(self.symbols[a:b])

    def token(self, i: int, position: int) -> int:
        """The id at ``position`` of document ``i``, expanding one symbol only."""
        a, b = (self.symbol_ends[i - 1] if i else 0), self.symbol_ends[i]
        symbols = self.symbols[a:b]
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        size[rule] = self.lengths[symbols[rule] - self.first]
        ends = np.cumsum(size)
        at = int(np.searchsorted(ends, position, "right"))
        return int(self.expand(symbols[at : at + 1])[position - (ends[at] - size[at])])


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        vocabulary = max(enc.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        docs, arrays, held, start, number = [], [], 0, 0, 0

        def flush():
            nonlocal docs, arrays, held, start, number
            data = write_block(docs, arrays, vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (number, pa.int64()), (start, pa.int64()), (held, pa.int64()), (data, pa.binary()))], names=["part", "block", "start", "tokens", "data"])
            start, number, docs, arrays, held = start + held, number + 1, [], [], 0

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                docs.append(doc)
                arrays.append(np.append(ids, np.uint32(end_id)))
                held += len(ids) + 1
                if held >= BLOCK:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def write_tokens(docs: DataFrame, table: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text by the vocabulary file ``path``, append ``end_id`` and write token blocks below ``table``.

    Documents lie in ascending order of their id, null ids first, rows with the
    same id in the order of a hash of their texts, then of the input. A null text is empty; an empty table gives no blocks. As many parts are
    written as the session has shuffle partitions.
    """
    spark = docs.sparkSession
    tune(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id are parted by their texts, and equal ones by their number, should a third of all have it
    rows = slim(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", F.xxhash64("text"), "row"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    ordered.mapInArrow(_encode(path, end_id), "part long, block long, start long, tokens long, data binary").write.parquet(table)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, data in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("data"), strict=True):
            block = Block(data.as_py())
            ids = block.expand(block.symbols).astype("<u4")
            ends = np.cumsum(block.tokens)
            begins = ends - block.tokens
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * block.docs, pa.int64()), pa.array(block.doc_ids, pa.int64()), pa.array(begins + start), pa.array(block.tokens), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_digests(spark: SparkSession, table: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files below ``table``; ``start`` counts the ids of all documents before."""
    schema = "part long, block long, start long, tokens long, data binary"
    stored = spark.read.schema(schema).parquet(table)
    totals = stored.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row a part
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    tune(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
    found = stored.select("part", "start", "data").mapInArrow(_digests, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what ``read_digests`` reads back from them."""
    spark = docs.sparkSession
    table = scratch(spark, "tokens")
    write_tokens(docs, table, path, end_id, id_col, text_col)
    return read_digests(spark, table)
