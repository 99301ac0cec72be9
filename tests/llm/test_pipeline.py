"""The pipeline against its stages done by brute force, one after another."""

from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_spans, odd, shingles_of  # noqa: E402, F401

from streetlens.llm import quality_rules  # noqa: E402
from streetlens.llm.docstats import Doc  # noqa: E402
from streetlens.llm.tokens import Encoder, vocabulary_path  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_run(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    good = [(d, t) for d, t in docs if not quality_rules.base_failed(Doc(t)) and not any(r.rejects(Doc(t)) for r in quality_rules.DEFAULT_RULES)]
    last = {}
    for d, t in good:
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in t)] = (d, t)
    exact = sorted(last.values())
    sets = [shingles_of(t, 5) for _, t in exact]
    group = list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    near = [exact[i] for i in range(len(exact)) if group[i] == i]
    gone = brute_spans(near, 4, 12)
    # the vocabulary is of words: white space between them changes nothing
    cut = [(d, " ".join(gone[d, t][0]) if (d, t) in gone else t) for d, t in near]
    enc = Encoder(vocabulary_path("word_bpe_49k.json"), fast=False)
    want = {d: len(enc.library.encode(t, add_special_tokens=False).ids) + 1 for d, t in cut if t}
    found = defaultdict(int)
    for r in corpus_pipeline.run(spark, DATA).collect():
        found[r.doc_id] += r.length
    assert dict(found) == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_stages_take_odd_rows(spark, odd):  # noqa: F811
    """Nulls, empty and long texts, ties, repeated rows, clashing names and an empty table, through every stage."""
    rows, df = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = df.withColumns({"n_chars": df["doc_id"], "_gone": df["row"], "_span_at": df["row"], "text_key": df["row"], "dedup_digest": df["row"], "_row_key": df["row"]})
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns and {r.doc_id for r in found.collect()} <= {r[0] for r in rows}, name
        assert stage(spark, docs.limit(0), DATA).collect() == [], name
    name, pack = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in pack(spark, df, DATA).collect()} == {r[0] for r in rows} and pack(spark, df.limit(0), DATA).collect() == []
