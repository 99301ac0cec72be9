"""Quality rules as a short-circuit cascade.

A rule rejects a document or lets it pass. Whether a document is kept does not
depend on the order of the rules, but the cost does: the cascade measures each
rule's cost and selectivity on a sample and evaluates the rules by rejections
per cost, stopping at the first rejection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, slim, tune
from .docstats import Doc

#: Rows of the sample that orders the rules, about. It decides about cost, never about results.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of a document with at least one word whether it fails."""

    name: str
    rejects: Callable[[Doc], bool]


# Thresholds of the default rules.
MAX_SYMBOLS_PER_WORD = 0.3
MIN_WORDLIKE = 0.7
MAX_UPPER = 0.35
MAX_SHOUTS_PER_WORD = 0.4
MAX_DUP_LINES = 0.35
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.0, 14.0
MAX_TOP_WORD = 0.3
MIN_DISTINCT = 0.03

DEFAULT_RULES = (
    Rule("symbols", lambda d: d.n_symbols > MAX_SYMBOLS_PER_WORD * d.n_words),
    Rule("wordlike", lambda d: d.n_wordlike < MIN_WORDLIKE * d.n_words),
    Rule("upper", lambda d: d.n_upper > MAX_UPPER * max(1, d.n_letters)),
    Rule("shouts", lambda d: d.n_shouts > MAX_SHOUTS_PER_WORD * d.n_words),
    Rule("dup_lines", lambda d: d.n_dup_lines > MAX_DUP_LINES * len(d.lines)),
    Rule("word_length", lambda d: not MIN_MEAN_WORD * d.n_words <= d.word_chars <= MAX_MEAN_WORD * d.n_words),
    Rule("top_word", lambda d: d.n_top_word > MAX_TOP_WORD * d.n_words),
    Rule("distinct", lambda d: d.n_distinct < MIN_DISTINCT * d.n_words),
)


def base_failed(d: Doc, min_words: int = 50, max_repeat_percent: int = 50) -> bool:
    return d.n_words < min_words or 100 * d.n_repeat_words > max_repeat_percent * d.n_words


def counts(d: Doc) -> tuple[int, int, int, int, int]:
    return d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words


def _measure(rules: tuple[Rule, ...]):
    """Per rule: seconds taken and documents rejected, of this partition's sample.

    A rule pays for what it needs beyond the base and the counts that are
    returned anyway: these are there before the cascade begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                known = Doc(text)
                if base_failed(known):
                    continue
                counts(known)
                for i, rule in enumerate(rules):
                    d = copy(known)  # with what is computed already, and nothing of the other rules
                    began = time.perf_counter()
                    rejected[i] += bool(rule.rejects(d))
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    return run


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """``rules`` by rejections per second on a hashed sample of about ``SAMPLE_ROWS`` rows of (doc_id, text)."""
    one_in = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    found = sample.mapInArrow(_measure(rules), "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"))
    rank = {row.rule: (row.r + 0.01) / (row.s + 1e-9) for row in found.collect()}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rank.get(i, 0.0), i)))


def _judge(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                d = Doc(text)
                failed = base_failed(d)
                rows.append((*counts(d), failed, not failed and not any(rule.rejects(d) for rule in rules)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [pa.array(c, pa.bool_() if i > 4 else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return run


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the base counts, whether the base failed, and the cascade's verdict.

    A null or empty text has no words and fails. Repeated rows get a row each,
    null ids are kept, an empty table gives an empty result, and other columns
    are ignored.
    """
    tune(docs.sparkSession)
    base = slim(docs, id_col, text_col)
    return base.mapInArrow(_judge(order_rules(base, rules)), SCHEMA)


def _filter(rules: tuple[Rule, ...], text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(text_at).to_pylist():
                d = Doc(text or "")
                keep.append(not base_failed(d) and not any(rule.rejects(d) for rule in rules))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base and every rule let pass, with all their columns.

    A null or empty text fails, repeated rows are judged each, null ids are
    kept, an empty table gives an empty result; the text is judged as a string
    whatever its type, and other columns may have any names.
    """
    tune(docs.sparkSession)
    ordered = order_rules(slim(docs, id_col, text_col), rules)
    (text,) = free_names(docs, "rule_text")
    marked = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return marked.mapInArrow(_filter(ordered, text), marked.schema).drop(text)
