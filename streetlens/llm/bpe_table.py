"""BPE encoding and decoding through a distinct-word table.

1. A sample finds the most frequent words; a table of at most ``COMMON_WORDS``
   of them, each encoded once, is sent to every worker.
2. Texts are split into words in one distributed pass; a chunk of neighbouring
   documents gives each of its other words once.
3. These are sorted by word; every distinct word is encoded once, as its run of
   rows passes by.
4. Decoding is a join of the distinct words' ids, by position, with the
   id-to-piece table of the vocabulary, which has a fixed size: no occurrence
   of a word is ever decoded twice.
5. Each chunk that has a word gets its ids and its decoded bytes, and meets its
   documents again in one task of bounded size, where they are split again and
   each word's ids and bytes are put at its positions. The documents travel
   compressed; the occurrences of words never do.

Texts of common characters are split by a pattern, others by the library's own
pre-tokenizer; only a text that holds a special token is one word as a whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slim, tune
from .tokens import BYTE_SPLIT, byte_alphabet, encoder

#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK = 24 << 20
#: Words of the common table, at most, and their greatest length; one row in so many is sampled for it.
COMMON_WORDS, COMMON_LENGTH, SAMPLE = 150_000, 24, 24
SPLIT = re.compile(BYTE_SPLIT)


def split_words(text: str, enc) -> list[str]:
    """The words of a text: encoding them one by one gives the text's ids."""
    if not text:
        return []
    if enc.words or any(x in text for x in enc.special):
        return [text]
    if enc.is_common(text):
        return SPLIT.findall(text)
    words = [text[a:b] for _, (a, b) in enc.library.pre_tokenizer.pre_tokenize_str(text)]
    return words if sum(map(len, words)) == len(text) else [text]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(chunk, ids, texts) of a partition; chunks are numbered by partition and position."""
    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            held += len(text)
            if held >= CHUNK:
                yield number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def _counted(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            counts = Counter(w for t in batch.column("text").to_pylist() for w in split_words(t, enc))
            found = [(w, n) for w, n in counts.items() if len(w) <= COMMON_LENGTH]
            words, n = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return run


class Table:
    """Words with their ids (little-endian uint32), and of the few that decode to other bytes than their own also these."""

    def __init__(self, found: pa.Table):
        self.ids = dict(zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True))
        other = found.filter(pc.is_valid(found.column("raw")))
        self.raw = dict(zip(other.column("word").to_pylist(), other.column("raw").to_pylist(), strict=True))


def look_up(word: str, own: Table, common: Table, path: str) -> tuple[bytes, bytes]:
    """(ids, bytes they decode to) of a word of a chunk, from its own words or the common ones.

    A word is in neither only where the input was dealt to chunks in another way
    when it was read again (an input that Spark recomputes in another order); it
    is then encoded on the spot.
    """
    for table in (own, common):
        ids = table.ids.get(word)
        if ids is not None:
            raw = table.raw.get(word)
            return ids, word.encode() if raw is None else raw
    ids, piece = encoder(path).encode([word])[0], _pieces(path)
    return ids.astype("<u4").tobytes(), b"".join([piece[i] for i in ids.tolist()])


def common_words(docs: DataFrame, path: str) -> Table:
    """The most frequent words of a sample of rows."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_counted(path), "word string, n long")
    top = sample.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    return Table(_known(top.select(F.lit(-1).cast("long").alias("chunk"), "word").repartition("word").sortWithinPartitions("word"), path).toArrow())


def _words(path: str, common):
    """Each chunk's words that the common table lacks, once."""

    def run(batches):
        enc = encoder(path)
        for chunk, _, texts in _chunks(batches):
            words: set[str] = set()
            for t in texts:
                words.update(split_words(t, enc))
            rest = list(words.difference(common.value.ids))
            for i in range(0, len(rest), 20_000):
                part = rest[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.string())], names=["chunk", "word"])

    return run


def _encode_runs(path: str):
    """From rows (chunk, word) sorted by word: (word, chunks, ids), each distinct word encoded once; a word of very many chunks has several rows."""

    def run(batches):
        enc, last, last_ids = encoder(path), None, None
        for batch in batches:
            words, chunks = batch.column("word").to_pylist(), batch.column("chunk")
            if not words:
                continue
            begin = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
            new = [words[i] for i in begin]
            ids = enc.encode(new[1:] if new[0] == last else new)
            ids = [last_ids, *ids] if new[0] == last else ids
            last, last_ids = new[-1], ids[-1]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.ListArray.from_arrays(pa.array([*begin, len(words)], pa.int32()), chunks), lists], names=["word", "chunks", "ids"])

    return run


def _gather(batches):
    """From rows (at, word, chunks, id, piece), each word's in a row by position: (chunk, word, ids, raw).

    ``raw`` are the bytes that the ids decode to, null where these are the word's own.
    """
    held: list = []  # the word that the last batch ended in: word, chunks, ids, bytes
    seen = -1

    def give(rows):
        columns = [(c, w, np.array(ids, "<u4").tobytes(), None if raw == w.encode() else raw) for w, chunks, ids, raw in rows for c in chunks]
        columns = list(zip(*columns, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "word", "ids", "raw"])

    for batch in batches:
        at, ids = batch.column("at").to_numpy(), batch.column("id").to_pylist()
        if not len(at):
            continue
        if (np.diff(at, prepend=seen) != 1)[at > 0].any():
            raise RuntimeError("the pieces of a word are not in a row")
        seen = int(at[-1])
        piece = batch.column("piece")
        offsets = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(at) + 1].tolist()
        data = piece.buffers()[2].to_pybytes() if offsets[-1] else b""
        begin = np.flatnonzero(at == 0).tolist()
        done = []
        first = begin[0] if begin else len(at)
        if held:
            held[0][2].extend(ids[:first])
            held[0][3] += data[offsets[0] : offsets[first]]
        if begin:
            words, chunks = (batch.column(c).take(pa.array(begin)).to_pylist() for c in ("word", "chunks"))
            done = [*held, *([w, c, ids[i:j], data[offsets[i] : offsets[j]]] for w, c, i, j in zip(words, chunks, begin, [*begin[1:], len(at)], strict=True))]
            held = [done.pop()]
        yield give(done)
    yield give(held)


def _known(words: DataFrame, path: str) -> DataFrame:
    """(chunk, word, ids, raw) for rows (chunk, word) that are sorted by word in their partitions.

    The table of distinct words is written once: a task then has one Python
    worker, and the shuffled words go. The join keeps a partition's rows in
    their order, as the small side is broadcast: nothing is shuffled to bring a
    word's pieces together again.
    """
    runs = materialize(words.mapInArrow(_encode_runs(path), "word string, chunks array<long>, ids array<int>"), "bpe-words")
    each = runs.select("word", "chunks", F.posexplode("ids").alias("at", "id"))
    first = F.col("at") == 0
    each = each.select("at", "id", F.when(first, F.col("word")).alias("word"), F.when(first, F.col("chunks")).alias("chunks"))
    joined = each.join(F.broadcast(piece_table(words.sparkSession, path)), "id").select("at", "word", "chunks", "id", "piece")
    return joined.mapInArrow(_gather, "chunk long, word string, ids binary, raw binary")


def _blobs(batches):
    pack = zstandard.ZstdCompressor(level=4)
    for chunk, ids, texts in _chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack.compress(pickle.dumps((ids, texts), 5))], pa.binary())], names=["chunk", "blob"])


def pieces(path: str) -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary decodes to; special tokens stand for their own text."""
    enc = encoder(path)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    return {i: token.encode() if token in enc.special else bytes(to_byte[c] for c in token) for token, i in enc.library.get_vocab(with_added_tokens=True).items()}


def _restore(path: str, digest: bool, common):
    """A chunk's documents and word ids brought together: one row a document."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        enc = encoder(path)
        own = Table(right)
        text_of: dict[str, tuple[int, str, bytes]] = {}
        docs, rows = [], []
        for blob in left.column("blob").to_pylist():
            numbers, texts = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
            docs += numbers
            for text in texts:
                words = split_words(text, enc)
                if not digest:
                    rows.append(np.frombuffer(b"".join([look_up(w, own, common.value, path)[0] for w in words]), "<u4").tolist())
                    continue
                found = []
                for w in words:
                    hit = text_of.get(w)
                    if hit is None:
                        ids, raw = look_up(w, own, common.value, path)
                        values = np.frombuffer(ids, "<u4").tolist()
                        hit = (len(values), ",".join(map(str, values)), raw)
                        if w in common.value.ids:  # others hardly ever come again: only common words are remembered
                            text_of[w] = hit
                    found.append(hit)
                n = sum([f[0] for f in found])
                listed = ",".join([f[1] for f in found])
                decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace")
                rows.append((n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        if not digest:
            return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))})
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(columns[0], pa.int64()), "ids_sha256": pa.array(columns[1], pa.string()), "decoded_sha256": pa.array(columns[2], pa.string())})

    return run


_PIECES: dict[str, dict[int, bytes]] = {}


def _pieces(path: str) -> dict[int, bytes]:
    if path not in _PIECES:
        _PIECES[path] = pieces(path)
    return _PIECES[path]


def _meet(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    base = slim(docs, id_col, text_col)
    common = spark.sparkContext.broadcast(common_words(base, path))
    words = base.mapInArrow(_words(path, common), "chunk long, word string").repartition(F.col("word")).sortWithinPartitions("word")
    known = _known(words, path)
    blobs = base.mapInArrow(_blobs, "chunk long, blob binary")
    return blobs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_restore(path, digest, common), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``: the ids that the tokenizers library gives without special tokens added.

    A null text is empty and has no ids. Repeated rows and ids get a row each;
    an empty table gives an empty result; other columns are ignored.
    """
    return _meet(docs, path, id_col, text_col, False, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, encoded and decoded again.

    The digests are of the decimal ids joined by commas and of the decoded text
    in UTF-8; rows are treated as by ``encode``.
    """
    return _meet(docs, path, id_col, text_col, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _join_pieces(path: str):
    def run(batches):
        piece = _pieces(path)
        for batch in batches:
            texts = [None if ids is None else b"".join([piece[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids): pieces joined and read as UTF-8, broken sequences replaced; null ids give a null text."""
    tune(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_join_pieces(path), "doc_id long, text string")


def piece_table(spark, path: str) -> DataFrame:
    """(id int, piece binary) of the vocabulary: its size is fixed."""
    return spark.createDataFrame(sorted(pieces(path).items()), "id int, piece binary")
