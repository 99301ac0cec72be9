"""Substring dedup over sliding sentence spans.

From every sentence on, and up to every sentence, the run of ``span`` consecutive
sentences, or of as many more as it takes to reach ``least_words`` words, is
hashed; the hashes are joined globally, and the sentences covered by any span
that is not the first of its hash are removed. Many texts are hashed at once
with numpy; a run's hash comes from running sums over the sentences' hashes.

Sentences are cut into parts of at most ``WINDOW`` words, at places that the
words around them decide. Less than ``WINDOW`` words from an end of a common
passage those may differ, elsewhere the parts are the same wherever the passage
lies in a line. So any ``3 * WINDOW - 2 + max(span * WINDOW, least_words - 1 + WINDOW)``
common words hold a whole span; less than ``2 * WINDOW`` words may stay at an
end that is not a sentence's. Lines that are broken elsewhere are other sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, free_names, materialize, slim, tune
from .words import MIX, Powers, Words, blocks, finalize, words_of_texts

#: Of so many words in a row within a sentence the one with the least hash, of equal ones the last, ends a part.
WINDOW = 5
_POWERS = Powers(int(MIX))
_LENGTH = 0xFFFFFFFF


class Sentences(NamedTuple):
    """Of each sentence the index of the word after it and its hash; of each text its first sentence (and their number)."""

    after: np.ndarray
    mixed: np.ndarray
    first: np.ndarray


def sentences(words: Words) -> Sentences:
    """The sentences of texts.

    A sentence ends with a word that ends in . ! or ?, or at a line end. It is
    cut after the word with the least hash of every ``WINDOW`` words in a row,
    so no part has more words than that; parts count as sentences.
    """
    h, n = words.hashes, len(words.hashes)
    if not n:
        return Sentences(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(words.first), np.int64))
    last = words.raw[words.end - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    ahead = np.concatenate([np.searchsorted(words.begin, np.flatnonzero(words.raw == 10)), words.first[1:]])
    stop[ahead[ahead > 0] - 1] = True
    if n >= WINDOW:
        number = np.cumsum(stop) - stop
        runs = np.ndarray((n - WINDOW + 1, WINDOW), h.dtype, h, h.itemsize * (WINDOW - 1), (h.itemsize, -h.itemsize))  # each backwards
        least = np.arange(WINDOW - 1, n) - runs.argmin(axis=1)
        stop[least[number[: n - WINDOW + 1] == number[WINDOW - 1 :]]] = True
    after = np.flatnonzero(stop) + 1
    sizes = np.diff(after, prepend=0)
    begin = after - sizes
    place = (np.arange(n) - np.repeat(begin, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.add.reduceat(finalize(h ^ finalize(place + np.uint64(1))), begin)
    return Sentences(after, mixed, np.searchsorted(after, words.first, "right"))


def span_hashes(s: Sentences, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the shortest runs from and up to each sentence that have ``span`` sentences and ``least_words`` words or more.

    A place is the index of the first sentence in its text times 2 ** 32, plus
    the number of sentences beyond ``span``.
    """
    m = len(s.after)
    index, text = np.arange(m), np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    low, high = s.first[text], s.first[text + 1]
    start = s.after - np.diff(s.after, prepend=0)
    to = np.maximum(index + span, np.searchsorted(s.after, start + least_words) + 1)  # the sentence after the run from each
    fro = np.minimum(index - span + 1, np.searchsorted(start, s.after - least_words, "right") - 1)  # the first of the run up to each
    forward = np.flatnonzero(to <= high)
    backward = np.flatnonzero(fro >= low)
    backward = backward[to[fro[backward]] != backward + 1]  # those that are not such runs from their first sentence anyway
    begin, end = np.concatenate([forward, fro[backward]]), np.concatenate([to[forward], backward + 1])
    up, down = _POWERS.first(m + 1)
    with np.errstate(over="ignore"):
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s.mixed * up[:m])])
        out = finalize((before[end] - before[begin]) * down[begin] ^ finalize((end - begin).astype(np.uint64)))
    return text[begin], (begin - low[begin]) << 32 | (end - begin - span), out.view(np.int64)


def remove_sentences(texts: list[str], places: list[list[int]], span: int) -> tuple[list[str], list[int]]:
    """``texts`` without the sentences of the runs at their ``places``, and how many words went from each.

    White space between two neighbours that stay is kept; where sentences
    went, one line break (if there was any) or one space is left, and none
    at the ends of the text. A text without places stays as it is.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = words_of_texts(raws)
    s = sentences(words)
    out, went = [], []
    for k, at in enumerate(places):
        if not at:
            out.append(texts[k])
            went.append(0)
            continue
        low, high = int(s.first[k]), int(s.first[k + 1])
        edges = np.zeros(high - low + 1, np.int64)
        place = np.array(at, np.int64)
        np.add.at(edges, place >> 32, 1)
        np.add.at(edges, (place >> 32) + span + (place & _LENGTH), -1)
        gone = np.cumsum(edges[:-1]) > 0
        after = s.after[low:high]
        sizes = np.diff(after, prepend=int(words.first[k]))
        went.append(int(sizes[gone].sum()))
        turns = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]))).reshape(-1, 2)  # runs of sentences that stay
        parts, before = [], None
        for i, j in turns.tolist():
            a, b = int(words.begin[after[i] - sizes[i]]), int(words.end[after[j - 1] - 1])
            if before is not None:
                parts.append(b"\n" if (words.raw[before:a] == 10).any() else b" ")
            parts.append(words.raw[a:b].tobytes())
            before = b
        out.append(b"".join(parts).decode("utf-8", "surrogatepass"))
    return out, went


def _spans(span: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in blocks(batch.column("text")):
                text, at, values = span_hashes(sentences(words), span, least_words)
                take = pa.array(text)
                columns = [batch.column(c).slice(i, j - i).take(take) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(values)], names=["doc_id", "text_key", "at", "h"])

    return run


def repeated_spans(docs: DataFrame, span: int = 4, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, at array<long>): the places of the runs of sentences of each text that are not the first of their kind.

    First is the span with the smallest (doc_id, text_key, position); a null id
    comes before all others. ``text_key`` is a hash of the text, so that rows
    with the same id but different texts are told apart. A null text is empty;
    texts without words have no spans; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    base = slim(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    spans = base.mapInArrow(_spans(span, least_words), "doc_id long, text_key long, at long, h long")
    # one row a hash and map task reaches the shuffle, however often a span repeats
    place = F.struct("doc_id", "text_key", "at")
    first = spans.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "first")
    first = materialize(first, "span-first")
    found = spans.join(first, "h").where(~F.struct("doc_id", "text_key", "at").eqNullSafe(F.col("first")))
    found = materialize(found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("at")), "span-repeats")
    discard(first)
    return found


def _cut(span: int, text: str, at: str, words: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, went = batch.column(text).to_pylist(), [0] * batch.num_rows
            places = batch.column(at).to_pylist()
            hit, held = [], 0
            for i, p in enumerate([*places, None]):
                if hit and (held >= 1 << 22 or i == len(places)):
                    new, counts = remove_sentences([texts[k] for k in hit], [places[k] for k in hit], span)
                    for k, t, n in zip(hit, new, counts, strict=True):
                        texts[k], went[k] = t, n
                    hit, held = [], 0
                if p:
                    hit.append(i)
                    held += len(texts[i])
            names = batch.schema.names
            keep = [i for i, c in enumerate(names) if c not in (text, at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array(went, pa.int64())], names=[*(names[i] for i in keep), text, words])

    return run


def cut_repeated(docs: DataFrame, span: int = 4, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of repeated spans removed, and the column ``removed_words`` (long) added (replaced if there).

    Every row stays, at worst with an empty text; a row without repeats, a
    null text among them, keeps its text untouched. Repeated rows with the same
    id and text are one document and lose the same spans. An empty table gives
    an empty result. Other columns stay as they are, whatever their names.
    """
    tune(docs.sparkSession)
    own_id, own_key, places, text, words, key = free_names(docs, "span_id", "span_key", "span_at", "span_text", "span_words", "row_key")
    found = repeated_spans(docs, span, least_words, id_col, text_col).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("at").alias(places))
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    joined = marked.join(found, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left")
    plain = [c for c in docs.columns if c not in (text_col, "removed_words")]
    ready = joined.select(*(f"`{c}`" for c in plain), F.col(f"`{text_col}`").cast("string").alias(text), places)
    kept = [f for f in ready.schema.fields if f.name in plain]
    schema = StructType([*kept, StructField(text, StringType()), StructField(words, LongType())])
    done = ready.mapInArrow(_cut(span, text, places, words), schema)
    return done.select(*(F.col(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "removed_words"), F.col(words).alias("removed_words"))
