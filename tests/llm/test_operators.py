"""Every operator against brute force, on documents with nulls, ties, repeats, odd characters and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from streetlens.llm import bpe_table, jaccard_join, packing, quality_classifier, quality_rules, queries, sharding, span_dedup, stream_dedup, token_store, url_filter
from streetlens.llm import components as uniting
from streetlens.llm.components import components
from streetlens.llm.docstats import Doc
from streetlens.llm.words import LONG, blocks, word_hash, words_of_texts
from streetlens.llm.tokens import Encoder, vocabulary_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, key string, sign string, digest string, part string, node string, h string, at string, n string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TEXT = "The quick brown fox jumps over it. Then the dog sleeps near a river. Nobody saw that coming at all. We went home late. "


def rows_of(texts):
    return [(i, t, *["x"] * 9) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, TEXT), (5, TEXT.upper()), (5, TEXT.upper()), (None, TEXT), (6, "a"), (7, long), (8, long + " end"), (9, "日本語 émile\u00a0x <|endoftext|> ß"), (10, "x\0y  z\r\n\n b"), (11, "### $$$ !!! ### $$$ !!!")]
    texts += [(100 + i, " ".join(rng.choice(words) for _ in range(80)) + ". " + TEXT) for i in range(12)]
    texts += [(200 + i, TEXT + "same " * 60 + str(i % 2)) for i in range(40)]
    return rows_of(texts), spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, want):
    return sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, want)))


# 10


def shingles_of(text, k):
    """The set itself: tuples of lower-cased words, no hashes."""
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute_components(docs, k, percent):
    sets = [shingles_of(t, k) for _, t, *_ in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(lambda: None)
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            least[root(i)] = d if least[root(i)] is None else min(d, least[root(i)])
    return [(d, len(sets[i]), least[root(i)]) for i, (d, *_) in enumerate(docs)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard(odd, k, percent):
    rows, df = odd
    assert same(jaccard_join.jaccard_components(df, k, percent).collect(), brute_components(rows, k, percent))


def test_jaccard_in_chunks(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = rng.choice(rows)[1].split() if rows and rng.random() < 0.7 else [f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 2, 9, 40]))]
        if w and rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 70)
    assert same(jaccard_join.jaccard_components(df, 2, 70).collect(), want)
    assert same(jaccard_join.jaccard_components(df, 2, 70, chunk_sets=5).collect(), want)
    assert same(jaccard_join.jaccard_components(df, 2, 70, chunk_shingles=60).collect(), want)


def test_families_of_edited_copies_cost_their_number(spark, monkeypatch):
    rng = random.Random(8)
    rows, phrase = [], [f"p{i}" for i in range(12)]
    for f in range(3):
        base = [f"{f}w{rng.randrange(400)}" for _ in range(90)] + phrase
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 14])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    dealt, searched = [], jaccard_join._searched
    monkeypatch.setattr(jaccard_join, "_searched", lambda tasks, *a: dealt.append(tasks.count()) or searched(tasks, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert same(jaccard_join.jaccard_components(df, 4, 85, chunk_sets=8).collect(), brute_components(rows, 4, 85))
    assert sum(dealt) <= 2 * len(rows)


@pytest.mark.parametrize("length", [1, 3])
def test_jaccard_with_long_lists(spark, monkeypatch, length):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", length)
    rng = random.Random(12)
    rows = []
    for i in range(250):
        w = rng.choice(rows)[1].split() if rows and rng.random() < 0.8 else [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        if rng.random() < 0.8:
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((2, 80), (4, 85)):
        assert same(jaccard_join.jaccard_components(df, k, percent).collect(), brute_components(rows, k, percent))
        assert same(jaccard_join.jaccard_components(df, k, percent, chunk_sets=4).collect(), brute_components(rows, k, percent))


@pytest.mark.parametrize("cuts", [1, 7])
def test_rows_that_need_no_counting_make_chains(cuts):
    """Edges of short lists have the components of all counted pairs; where no count is needed they are as many as the rows."""
    rng = random.Random(cuts)
    n, need = [rng.randrange(80, 125) for _ in range(60)], 3
    gone = [rng.choice([0, 1, 2]) for _ in n]

    def edges(lists, gone):
        rows = sorted((2 * sign, n[x], x, need, gone[x], 0, int(gone[x] >= need - 1)) for sign, nodes in enumerate(lists) for x in nodes)
        size = -(-len(rows) // cuts)
        names = ["sign", "n", "node", "need", "gone", "long", "easy"]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=names) for i in range(0, len(rows), size)]
        return [(r["a"], r["b"], r["wanted"]) for out in jaccard_join._edges(90)(iter(batches)) for r in out.to_pylist()]

    def parts(pairs):
        group = list(range(len(n)))
        for a, b in pairs:
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        return group

    for _ in range(20):
        lists = [rng.sample(range(len(n)), rng.choice([2, 3, 9])) for _ in range(12)]
        seen = Counter(tuple(sorted(p)) for nodes in lists for p in combinations(nodes, 2) if 100 * min(n[p[0]], n[p[1]]) >= 90 * max(n[p[0]], n[p[1]]))
        found = edges(lists, gone)
        wanted = {(a, b): w for a, b, w in found}
        assert parts([p for p, c in Counter((a, b) for a, b, _ in found).items() if c >= wanted[p]]) == parts([p for p, c in seen.items() if c >= need - max(gone[p[0]], gone[p[1]])])
    assert len(edges([range(60)], [2] * 60)) < 60


def test_components_leave_one_forest(spark, monkeypatch):
    """Edges of one group that lie in many partitions are united by one task, not by each of its own."""
    made, write = [], uniting.materialize
    monkeypatch.setattr(uniting, "materialize", lambda df, name: made.append(write(df, name)) or made[-1])
    monkeypatch.setattr(uniting, "discard", lambda df: None)
    edges = [(a, b) for a in range(40) for b in range(a)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(16))
    assert sorted(tuple(r) for r in found.collect()) == [(x, 0) for x in range(40)]
    assert [df.count() for df in made] == [len(edges), 39]
    monkeypatch.setattr(uniting, "AT_ONCE", 100)
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(16))
    assert sorted(tuple(r) for r in found.collect()) == [(x, 0) for x in range(40)]


def test_jaccard_broadcasts_no_table_of_rows(spark, monkeypatch):
    """Tables with a row per text or set don't go through the driver, however small their files look."""
    plans, write = {}, jaccard_join.materialize

    def planned(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: plans.update({name: planned(df)}) or write(df, name))
    rows = [(i, " ".join(f"{i // 2}w{j}" for j in range(40 + i % 2))) for i in range(40)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert "SortMergeJoin" in planned(found) and "Broadcast" not in planned(found)
    assert "SortMergeJoin [key" in plans["jaccard-lists"] and "BroadcastHashJoin [key" not in plans["jaccard-lists"]
    assert "SortMergeJoin [node" in plans["jaccard-sets"] and "BroadcastHashJoin [node" not in plans["jaccard-sets"]
    assert same(found.collect(), brute_components(rows, 4, 85))


def test_jaccard_with_null_and_repeated_ids(spark):
    rng = random.Random(15)
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(30)}" for _ in range(40)] if i % 4 == 0 else rows[-1][1].split()
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((None if i % 3 == 0 else i % 7, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert same(jaccard_join.jaccard_components(df, 2, 70, chunk_sets=7).collect(), brute_components(rows, 2, 70))


def test_one_document_of_each_group_stays_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, c), (None, c + " end"), (5, None), (6, ""), (2, b)]
    names = ["gone_id", "Text_Key", "_gone", "key"]
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = jaccard_join.nearest_kept(df)
    assert kept.columns == df.columns
    assert same([(r.doc_id, r.text) for r in kept.collect()], [(1, a), (2, b), (2, b), (4, c), (None, c + " end"), (5, None), (6, "")])


def test_words():
    rng = random.Random(21)
    texts = ["", " \n a", "abc DEF  ghi\n", "x" * 200 + " y " + "X" * 200, "é日本 z", "A" * LONG] + ["".join(rng.choice("abC\n\t.é ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    import pyarrow as pa

    found = [w for i, j, part in blocks(pa.array(["?", *texts]).slice(1)) for w in part.hashes.tolist()]
    assert found == [word_hash(w) for t in texts for w in t.encode().split()]
    assert word_hash(b"A" * 90) == word_hash(b"a" * 90) != word_hash(b"a" * 91) and word_hash("É".encode()) != word_hash("é".encode())


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


def test_merge_skip():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(0, 8))]
        wanted = rng.randint(1, 5)
        counts = Counter(x for v in lists for x in v)
        assert dict(jaccard_join.merge_skip(lists, wanted)) == {x: c for x, c in counts.items() if c >= wanted}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7), (200, 200), (102, 100)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("at_once", [3, 10_000])
def test_few_edges_are_united_by_one_task(spark, monkeypatch, at_once):
    from streetlens.llm import components as module

    rounds, star = [], module._large_star
    monkeypatch.setattr(module, "_large_star", lambda edges: rounds.append(1) or star(edges))
    monkeypatch.setattr(module, "AT_ONCE", at_once, raising=False)
    rng = random.Random(2)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(900):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert {x: found.get(x, x) for x in least} == least
    assert bool(rounds) == (at_once == 3)


# 6


def brute_dedup(rows):
    groups = defaultdict(list)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for d, t, *_ in rows:
        groups[(t or "").translate(lower)].append(d)
    return {t: (max((d for d in g if d is not None), default=None), len(g)) for t, g in groups.items()}, lower


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(odd, weak):
    from pyspark.sql import functions as F

    rows, df = odd
    digest = (lambda t: F.unhex(F.hex(F.length(t) % 3))) if weak else stream_dedup.sha256
    want, lower = brute_dedup(rows)
    found = stream_dedup.exact_dedup(df, digest=digest).collect()
    expected = [(d, *want[(t or "").translate(lower)]) for d, t, *_ in rows]
    assert same([(r.doc_id, r.keep_id, r.group_size) for r in found], expected)
    assert sum(r.kept for r in found) == len(want)
    kept = stream_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert same([(r.doc_id,) for r in kept.collect()], [(k,) for k, _ in want.values()])


def test_exact_dedup_in_many_micro_batches(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(stream_dedup, "BATCH_BYTES", "1")
    want, lower = brute_dedup(rows)
    found = stream_dedup.exact_dedup(df).collect()
    assert same([(r.doc_id, r.keep_id, r.group_size) for r in found], [(d, *want[(t or "").translate(lower)]) for d, t, *_ in rows])
    assert sum(r.kept for r in found) == len(want)


def test_exact_dedup_empty(empty):
    assert stream_dedup.exact_dedup(empty).collect() == [] and stream_dedup.keep_one(empty).collect() == []


# 2


def brute_stats(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    repeats = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(inside)


def test_quality_rules(odd):
    rows, df = odd
    found = quality_rules.judge(df).collect()
    want = []
    for d, t, *_ in rows:
        n, c, s, lines, rep = brute_stats(t)
        failed = n < 50 or 100 * rep > 50 * n
        want.append((d, n, c, s, lines, rep, failed, not failed and not any(rule.rejects(Doc(t)) for rule in quality_rules.DEFAULT_RULES)))
    assert same(found, want)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and same([(r.doc_id,) for r in kept.collect()], [(w[0],) for w in want if w[-1]])


def test_order_of_rules_changes_nothing(odd):
    _, df = odd
    assert same(quality_rules.judge(df, quality_rules.DEFAULT_RULES[::-1]).collect(), quality_rules.judge(df).collect())


def test_quality_rules_empty(empty):
    assert quality_rules.judge(empty).collect() == []


# 3


def test_sharding(odd, spark):
    rows, df = odd
    found = sharding.shard(df, 5).collect()
    assert same([(r.doc_id, r.size, r.text_crc32) for r in found], [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows])
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(5))


def test_shards_are_near_equal_with_a_hot_text(spark):
    docs = [(i if i % 5 else None, "hot text " * 20 if i % 3 == 0 else f"text {i // 2} " * (5 + i // 2 % 40)) for i in range(6000)]
    found = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    loads, homes = Counter(), defaultdict(set)
    for r in found:
        loads[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < 1.02 * mean and min(loads.values()) > 0.97 * mean
    hot = zlib.crc32(("hot text " * 20).encode())
    assert len(homes[hot]) > 1 and all(len(v) == 1 for k, v in homes.items() if k != hot)


def test_shards_of_the_test_documents_keep_groups_together(spark):
    found = queries.op3_sharding(spark, "/root/testdata/sf0.01").collect()
    mean = sum(r.size for r in found) / 40
    groups = defaultdict(list)
    for r in found:
        groups[r.text_crc32].append(r)
    assert all(len({r.shard for r in g}) == 1 for g in groups.values() if sum(r.size for r in g) <= sharding.HOT * mean)


def brute_place(units, shards, slack):
    """The rule itself: heaviest first, clockwise from the unit's point to the first shard with room."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> 1, s) for s in range(shards) for v in range(sharding.VIRTUAL))
    loads, out, total = [0] * shards, {}, sum(load for _, _, load in units)
    for unit, point, load in sorted(units, key=lambda u: (-u[2], u[0])):
        room = max(-(-total * (1000 + round(1000 * slack)) // (1000 * shards)), -(-sum(loads) // shards) + load)
        turn = [s for p, s in nodes if p >= point] + [s for _, s in nodes]
        out[unit] = next(s for s in turn if loads[s] + load <= room)
        loads[out[unit]] += load
    return out, loads


def test_placing_is_bounded_and_moves_little():
    rng = random.Random(9)
    for shards, most in ((5, 100), (12, 5000), (3, 1)):
        units = [(u, rng.getrandbits(63), rng.randint(1, most if u % 50 == 0 else 100)) for u in range(600)]
        want, loads = brute_place(units, shards, sharding.SLACK)
        assert dict(sharding.place(units, shards)) == want
        assert max(loads) <= max(sum(loads) / shards * (1 + sharding.SLACK) + 1, sum(loads) / shards + max(u[2] for u in units) + 1)
    units = [(u, rng.getrandbits(63), 100 + u % 7) for u in range(20_000)]
    before, after = dict(sharding.place(units, 40)), dict(sharding.place(units, 41))
    moved = sum(u[2] for u in units if before[u[0]] != after[u[0]]) / sum(u[2] for u in units)
    assert moved < 0.08  # dealing by a hash of the unit would move 40 of 41


def test_ring_is_stable():
    points, owners = sharding.ring(5)
    more, theirs = sharding.ring(6)
    kept = dict(zip(points.tolist(), owners.tolist(), strict=True))
    assert all(kept[p] == s for p, s in zip(more.tolist(), theirs.tolist(), strict=True) if s < 5)


def test_sharding_empty(empty):
    assert sharding.shard(empty, 4).collect() == []


# 4


def test_token_store(odd):
    rows, df = odd
    path = vocabulary_path("byte_bpe_50k.json")
    enc = Encoder(path, fast=False)
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*enc.library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert same(token_store.store_and_read(df, path, 2).collect(), want)


def test_token_blocks():
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 40, rng.integers(1, 400)).astype(np.uint32) for _ in range(200)] + [np.full(999, 7, np.uint32), np.array([70_000], np.uint32)]
    block = token_store.Block(token_store.write_block([None, *range(201)], arrays, 80_000))
    assert block.doc_ids == [None, *range(201)] and len(block.symbols) < 0.9 * sum(map(len, arrays))
    assert all(np.array_equal(block.document(i), a) for i, a in enumerate(arrays))
    assert all(block.token(i, len(a) // 2) == a[len(a) // 2] for i, a in enumerate(arrays))


def test_token_blocks_replace_pairs_until_none_is_frequent():
    copy = np.random.default_rng(3).integers(0, 5000, 600).astype(np.uint32)
    block = token_store.Block(token_store.write_block(list(range(300)), [copy] * 300, 5000))
    assert len(block.symbols) == 300 and block.lengths.max() == 600
    assert all(np.array_equal(block.document(i), copy) for i in (0, 299))
    zero = int(np.flatnonzero(token_store._bucket(np.arange(1 << 20)) == 0)[1])  # the pair (0, zero) is in bucket 0
    pair = np.array([0, zero], np.uint32)
    block = token_store.Block(token_store.write_block(list(range(50)), [pair] * 50, 1 << 20))
    assert len(block.symbols) == 50 and np.array_equal(block.document(49), pair)


def test_token_store_empty(empty):
    assert token_store.store_and_read(empty, vocabulary_path("byte_bpe_50k.json"), 2).collect() == []


# 5


def test_classifier_holds_out(spark):
    found = queries.op5_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_classifier_odd_rows(odd, spark, empty):
    rows, df = odd
    labels = spark.createDataFrame([(4, 1), (4, 1), (100, 1), (101, 0), (9999, 0), (None, 1), (102, None), (103, 7)], "doc_id long, quality int")
    found = quality_classifier.classify(df, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert quality_classifier.classify(empty, labels).collect() == []
    assert len(quality_classifier.classify(df, labels.limit(0)).collect()) == len(rows)


def test_discriminant_against_its_definition():
    rng = np.random.default_rng(4)
    size = quality_classifier.SIZE
    x = rng.normal(size=(400, size)) * rng.uniform(0.5, 2, size) + quality_classifier.CENTER + 1
    y = (rng.random(400) < 0.3).astype(int)
    x[y == 1] += 0.4
    counts = np.array([(y == c).sum() for c in (0, 1)], float)
    shifted = x - quality_classifier.CENTER
    model = quality_classifier.fit(counts, np.array([shifted[y == c].sum(0) for c in (0, 1)]), np.array([shifted[y == c].T @ shifted[y == c] for c in (0, 1)]))
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    within = sum(n * np.diag(c) for n, c in zip(counts, covs, strict=True)) / counts.sum()
    logs = []
    for c in (0, 1):
        cov = (1 - quality_classifier.SHRINK) * covs[c] + quality_classifier.SHRINK * np.diag(within) + quality_classifier.FLOOR * np.eye(size)
        d = x - x[y == c].mean(0)
        logs.append(np.log((counts[c] + 1) / 402) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality_classifier.TEMPER))
    assert np.allclose(model.scores(x), want)


def test_classifier_threshold_includes_ties():
    import pyarrow as pa

    class Fixed:
        def scores(self, x):
            return np.array([0.7, 0.6999999, 1.0])

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[0.0] * quality_classifier.SIZE] * 3)], names=["doc_id", "x"])
    (found,) = quality_classifier._score(Fixed(), 0.7)([batch])
    assert found.column("predicted").to_pylist() == [1, 0, 1]


# 7


def brute_windows(lengths, size, spaces):
    """Best fit with a bounded number of open windows, by the definition."""
    windows, still, out = [], [], []
    for n in lengths:
        fits = [w for w in still if windows[w] + n <= size]
        if n == size or not fits:
            if n < size and len(still) == spaces:
                still.remove(max(still, key=lambda w: (windows[w], -w)))
            windows.append(0)
            fits = [len(windows) - 1]
            if n < size:
                still.append(fits[0])
        w = max(fits, key=lambda w: (windows[w], -w))
        out.append((w, windows[w]))
        windows[w] += n
        if windows[w] == size and w in still:
            still.remove(w)
    return out


def test_packer_places_best_fit():
    rng = random.Random(13)
    for spaces in (1, 3, 64):
        lengths = [rng.choice([rng.randint(1, 32), rng.randint(1, 8), 16, 32]) for _ in range(800)]
        packer = packing.Packer(32, spaces)
        assert [packer.place(n) for n in lengths] == brute_windows(lengths, 32, spaces)


def test_packing(odd):
    rows, df = odd
    path = vocabulary_path("word_bpe_49k.json")
    enc = Encoder(path, fast=False)
    found = packing.pack(df, path, 1, 64).collect()
    total = sum(len(enc.library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert sum(r.length for r in found) == total
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    want = []
    for d, t, *_ in rows:
        ids = np.array([*enc.library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, a, min(64, len(ids) - a), zlib.crc32(ids[a : a + 64].tobytes()), len(ids)) for a in range(0, len(ids), 64)]
    assert same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found], want)


def test_packing_wastes_little(spark):
    found = queries.op7_packing(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.length for r in found) > 0.95 * 2048 * len({r.sequence_id for r in found})


def test_packing_empty(empty):
    assert packing.pack(empty, vocabulary_path("word_bpe_49k.json"), 1).collect() == []


# 8


def brute_sentences(text):
    """[(words)] of each sentence or part, by the definition: nothing of the operator's but the hash of a word."""
    out = []
    for line in (text or "").split("\n"):
        sentence = []
        words = line.encode().split()
        for i, w in enumerate(words):
            sentence.append(w)
            if w[-1:] in (b".", b"!", b"?") or i == len(words) - 1:
                h = [word_hash(x) for x in sentence]
                ends = {max(range(j, j + span_dedup.WINDOW), key=lambda x: (-h[x], x)) for j in range(len(h) - span_dedup.WINDOW + 1)} | {len(h) - 1}
                begin = 0
                for e in sorted(ends):
                    out.append([x.decode().translate(LOWER) for x in sentence[begin : e + 1]])
                    begin = e + 1
                sentence = []
    return out


def brute_runs(parts, span, least):
    """Every (first, after last) run that is the shortest one from or up to a sentence with enough sentences and words."""
    found = set()
    for i in range(len(parts)):
        for step in (1, -1):
            run, words = [i], len(parts[i])
            while (len(run) < span or words < least) and 0 <= run[-1] + step < len(parts):
                run.append(run[-1] + step)
                words += len(parts[run[-1]])
            if len(run) >= span and words >= least:
                found.add((min(run), max(run) + 1))
    return found


def brute_spans(rows, span, least):
    """{(id, text): (words left, words removed)} for texts that lose some."""
    every = {}
    for d, t in {(r[0], r[1] or "") for r in rows}:
        parts = brute_sentences(t)
        for i, e in brute_runs(parts, span, least):
            every.setdefault(tuple(map(tuple, parts[i:e])), []).append((d, t, i, e))
    gone = defaultdict(set)
    for found in every.values():
        first = min(found, key=lambda f: (f[0] is not None, f[0] or 0, f[2]))
        for d, t, i, e in found:
            if (d, t, i, e) != first:
                gone[d, t].update(range(i, e))
    out = {}
    for (d, t), cut in gone.items():
        parts, words = brute_sentences(t), t.encode().split()
        at, left = 0, []
        for i, p in enumerate(parts):
            left += words[at : at + len(p)] if i not in cut else []
            at += len(p)
        out[d, t] = [w.decode() for w in left], len(words) - len(left)
    return out


def test_span_dedup(odd):
    rows, df = odd
    gone = brute_spans(rows, 2, 5)
    assert gone
    found = span_dedup.cut_repeated(df, 2, 5)
    assert found.columns == [*df.columns, "removed_words"]
    for r in found.collect():
        left = gone.get((r.doc_id, r.text)) or next((g for (d, t), g in gone.items() if d == r.doc_id and g[0] == (r.text or "").split()), None)
        assert r.removed_words == (left[1] if left else 0), r.doc_id
    want = [(d, *gone[d, t or ""]) if (d, t or "") in gone else (d, [w.decode() for w in (t or "").encode().split()], 0) for d, t, *_ in rows]
    assert same([(r.doc_id, [w.decode() for w in (r.text or "").encode().split()], r.removed_words) for r in found.collect()], want)
    untouched = {(d, t) for d, t, *_ in rows if (d, t or "") not in gone}
    assert untouched <= {(r.doc_id, r.text) for r in found.collect()}


def test_span_dedup_leaves_white_space_between_what_stays(spark):
    own = ["Alpha  beta gamma one.", "Zeta eta\ttheta two."]
    passage = "One common passage here. It has several sentences now. They all come twice over. This is its end."
    docs = [(1, passage), (2, f"{own[0]}\n\n {passage}\n{own[1]}"), (3, f"{own[0]} {passage} \t"), (4, passage)]
    found = {r.doc_id: r.text for r in span_dedup.cut_repeated(spark.createDataFrame(docs, "doc_id long, text string"), 2, 8).collect()}
    assert found[1] == passage and found[4] == "" and found[2].startswith(own[0] + "\n") and found[2].endswith(own[1])


def test_span_dedup_removes_a_planted_passage(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(4000)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(9)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    docs = [(i, " ".join([sentence() for _ in range(5)] + ([passage] if i in (3, 7) else []) + [sentence() for _ in range(5)])) for i in range(10)]
    found = {r.doc_id: r for r in span_dedup.cut_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage in found[3].text and found[7].removed_words == 72 and all(found[i].removed_words == 0 for i in range(10) if i != 7)


def places_and_hashes(words):
    _, at, values = span_dedup.span_hashes(span_dedup.sentences(words_of_texts([" ".join(words).encode()])), 4, 12)
    return dict(zip(values.tolist(), at.tolist(), strict=True))


@pytest.mark.parametrize("kind", ["no stops", "stops", "short sentences", "few words", "one word"])
def test_any_fifty_common_words_hold_a_span(kind):
    rng = random.Random(5)
    end = {"stops": lambda i: "." * (rng.random() < 0.1), "short sentences": lambda i: "." * (i % 2)}.get(kind, lambda i: "")
    words = [f"u{i}" for i in range({"few words": 3, "one word": 1}.get(kind, 3000))]
    some = lambda n: [rng.choice(words) + end(i) for i in range(n)]
    for _ in range(1500):
        passage = some(50)
        a, b = (places_and_hashes(["x", *some(rng.randint(0, 12)), *passage, *some(rng.randint(0, 12)), "y"]) for _ in range(2))
        assert set(a) & set(b)
    for _ in range(300):  # no part is longer than the window
        after = span_dedup.sentences(words_of_texts([" ".join(some(200)).encode()])).after
        assert np.diff(after, prepend=0).max() <= span_dedup.WINDOW


def test_span_dedup_finds_a_passage_without_stops_in_the_middle_of_lines(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [some(51) for _ in range(400)]
    docs = [(1000 * k + i, f"{some(rng.randint(5, 20))} {p} {some(rng.randint(5, 20))}") for k in range(2) for i, p in enumerate(passages)]
    found = {r.doc_id: r for r in span_dedup.cut_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, p in enumerate(passages):
        assert found[i].removed_words == 0 and 51 - 4 * span_dedup.WINDOW < found[1000 + i].removed_words <= 51, p


def test_span_dedup_empty(empty):
    assert span_dedup.cut_repeated(empty).collect() == []


# 9


def test_bpe_table(odd, monkeypatch, spark):
    rows, df = odd
    path = vocabulary_path("byte_bpe_50k.json")
    enc = Encoder(path, fast=False)
    want = []
    for d, t, *_ in rows:
        ids = enc.library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert same(bpe_table.round_trip_digests(df, path).collect(), want)
    encoded = bpe_table.encode(df, path)
    decoded = bpe_table.decode(encoded, path).collect()
    assert same(decoded, [(d, t or "") for d, t, *_ in rows])


def test_bpe_table_of_all_scripts(spark):
    """Other scripts, emoji and marks are split into words, too, and missing words are encoded on the spot."""
    path = vocabulary_path("byte_bpe_50k.json")
    enc, rng = Encoder(path, fast=False), random.Random(12)
    bits = ["привет мир", "日本語のテキスト", " 😀👍🏽", "naïve\u00a0café", "e\u0301 x", "ไทย", "عربي ١٢٣", "\n\n  ", "it's we’ll", "Łódź 12", "\u200b", "²½", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for t in texts:
        words = bpe_table.split_words(t, enc)
        assert "".join(words) == t and (len(words) > 1 or "<|endoftext|>" in t or len(t) < 20)
    want = []
    for i, t in enumerate(texts):
        ids = enc.library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert same(bpe_table.round_trip_digests(df, path).collect(), want)
    import pyarrow as pa

    none = bpe_table.Table(pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.binary()), "raw": pa.array([], pa.binary())}))
    for t in texts[:50]:
        assert b"".join(bpe_table.look_up(w, none, none, path)[1] for w in bpe_table.split_words(t, enc)).decode("utf-8", "replace") == t


def test_bpe_table_empty(empty):
    assert bpe_table.round_trip_digests(empty, vocabulary_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_engine_equals_library(name):
    rng = random.Random(8)
    enc = Encoder(vocabulary_path(name))
    assert enc.engine is not None
    alphabet = "abcXYZ éßÖñ '’sdtrevml0123 \n\t  .,!?#$_-“”<|>ø日\u00a0²İ\u0301"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>"]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == enc.library.encode(text, add_special_tokens=False).ids


# 1


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?y#z", "https://example.net/de/8/1", "https://sub.example.net/de/9", "ftp://org", "http://x.org/es/", "http://borg/es/a", "http://org/es/a#b", "a://b://c.com/en/", "http://com/en/", "http://x.com?/en/", "http://é.com/en/ü", "http://x.com./en/1"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls * 2)] + [(None, urls[4], "x", "y")], "page_id long, url string, host string, key string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")

    def judge(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        best = max((r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    found = url_filter.filter_urls(pages, rules)
    assert same([r[:5] for r in found.collect()], [(r.page_id, *judge(r.url)) for r in pages.collect()])
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_url_filter_with_lists_of_many_shapes(spark):
    rng = random.Random(14)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy") for _ in range(rng.randint(0, 6)))
    listed = [(host(), path() if rng.random() < 0.9 else None, rng.choice(["allow", "block"])) for _ in range(150)] + [(None, "/", "block"), ("", "/", "block")]
    urls = [(i, f"http://{host()}{path()}") for i in range(800)]
    found = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(listed, "host string, path string, verdict string"))
    for r in found.collect():
        fits = [(len(h + (p or "")), len(h), v == "allow", h + (p or ""), v) for h, p, v in listed if h and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p or "")]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "allow")), r


def test_bloom_filter_passes_all_listed(spark):
    from pyspark.sql import functions as F

    rules = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/a").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/a")).alias("url"))
    found = url_filter.filter_urls(pages, rules)
    assert found.where("page_id < 3000 and verdict <> 'block'").count() == 0 and found.where("page_id >= 3000 and verdict <> 'allow'").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    found = queries.QUERIES[name](spark, DATA)
    assert found.columns == want.columns and same(found.collect(), want.fetchall())
