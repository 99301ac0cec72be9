"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Every text becomes the set of its distinct word shingles. Two sets link when
their Jaccard similarity reaches a threshold; the result is each document's
connected component. Nothing is sampled, capped or approximated in the result.

How it is spread over a cluster:

1. One pass over the texts gives each set's size, digest and *signatures*. Two
   sets that link differ in at most D shingles, so when the hash space is cut
   into K = D + T + E segments, at least T segments agree that are not empty.
   A signature is the hash of all shingles in a segment; unrelated sets that
   share a passage or a phrase hardly ever agree on one. K depends on a size
   class; a set signs for its own class and the next larger one.
2. Equal sets collapse to one node. Signatures are sorted, only those with two
   nodes or more stay, and a node stays only if T of its signatures do (T
   occurrences). Within each inverted list, nodes whose sizes allow the
   threshold are joined by a spanning forest, never by all pairs.
3. The components of that graph are the search blocks. Within one the
   T-occurrence search runs on full sets: the short inverted lists of a query
   are heap-merged with skips, the long ones binary-probed, and sets that reach
   the required overlap are united.
4. A block above a bound of sets or shingles is parted anew by the rarest
   shingles of its sets (``_narrowed``). Then sets are compared by how they
   differ from the shingles that most of them hold (``_by_difference``): those
   that differ little link without a search, those that can link with nothing
   that is still apart leave it.
   What stays, if above the bound, is cut into chunks that are
   searched apart; then some members of each component found so are searched
   together. What is still apart is searched exhaustively: the sets outside the
   block's largest component are dealt to the chunks of those inside, and to
   one another. No task ever holds more than the bound. Edited copies of one
   text cost their number, not its square; what stays apart after all this does
   cost its square.
5. Components of the links are joined back to the rows.

Sets hold 64-bit hashes of shingles: "equal" and "overlap" are meant up to
collisions of these, whose chance for a pair of sets is about 2 ** -50.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, materialize, slim, tune
from .components import components
from .shingles import shingle_sets
from .words import MIX, blocks as text_blocks, finalize

#: Digests whose signatures a worker remembers to have given already.
REMEMBER = 500_000
#: How DivideSkip weighs a binary probe against a heap step when it sets long lists aside.
PROBE_COST = 0.02
#: Sets and shingles of a chunk, at most (a larger set is a chunk of its own); members of a component that stand for it.
#: Nodes of an inverted list of signatures up to which all its pairs are counted.
LONG_LIST = 64
CHUNK_SETS, CHUNK_SHINGLES, DELEGATES = 1000, 1_000_000, 8


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def required_overlap(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of ``n`` and ``m`` with 100 * overlap >= percent * union."""
    return ceil_div(percent * (n + m), 100 + percent)


def search_block(nodes: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(node, root) for every node that some link unites with a smaller root.

    ``nodes`` are distinct ids, ``sets`` their sorted shingles; sets with the
    same value of ``known`` are united from the start. Queries run in ascending
    order of size against the sets before them.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    nodes, sets = nodes[order], [sets[i] for i in order]
    known = np.arange(len(sets)) if known is None else np.unique(known[order], return_inverse=True)[1]
    total = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.concatenate(sets) if total else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(total), sizes)
    _, rank, count = np.unique(tokens, return_inverse=True, return_counts=True)
    by = np.argsort(rank, kind="stable")  # owners ascend within a shingle
    flat = owner[by]
    probe = rank[by] * total + flat
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    first = np.concatenate([[0], np.cumsum(count)])[rank]
    label = known.tolist()
    members: dict[int, list[int]] = {}
    for i, a in enumerate(label):
        members.setdefault(a, []).append(i)
    labels = known.copy()

    def unite(x: int, y: int) -> None:
        a, b = label[x], label[y]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        moved = members.pop(b)
        members[a] += moved
        for i in moved:
            label[i] = a
        labels[moved] = a

    for x in range(1, total):
        n = int(sizes[x])
        least = ceil_div(percent * n, 100)
        low = int(np.searchsorted(sizes[:x], least))
        if not (labels[low:x] != label[x]).any():
            continue
        own = slice(start[x], start[x + 1])
        begin, end, ranks = first[own], place[own], rank[own]
        used = end > begin
        lists = int(used.sum())
        need = required_overlap(n, least, percent)
        if lists < need:
            continue
        begin, end, ranks = begin[used], end[used], ranks[used]
        by_length = np.argsort(end - begin, kind="stable")
        begin, end, ranks = begin[by_length], end[by_length], ranks[by_length]
        # the set before it that shares its rarest shingles links most often: then one component less is searched
        y = int(flat[end[0] - 1])
        if y >= low and label[y] != label[x] and _hits(probe, ranks, y, total) >= required_overlap(n, int(sizes[y]), percent):
            unite(x, y)
            if not (labels[low:x] != label[x]).any():
                continue
        longest = int(end[-1] - begin[-1])
        aside = min(need - 1, int(need / (PROBE_COST * np.log2(longest + 1) + 1)))
        short, wanted = lists - aside, need - aside
        kept = []
        for a, b in zip(begin[:short].tolist(), end[:short].tolist(), strict=True):
            part = flat[a:b]
            part = part[(part >= low) & (labels[part] != label[x])]
            if len(part):
                kept.append(part.tolist())
        for y, seen in merge_skip(kept, wanted):
            if label[y] != label[x] and seen + _hits(probe, ranks[short:], y, total) >= required_overlap(n, int(sizes[y]), percent):
                unite(x, y)
    out = []
    for group in members.values():
        if len(group) > 1:
            ids = sorted(int(nodes[i]) for i in group)
            out += [(i, ids[0]) for i in ids[1:]]
    return out


def _hits(probe: np.ndarray, ranks: np.ndarray, y: int, total: int) -> int:
    """In how many of the inverted lists ``ranks`` the set ``y`` is, by binary search."""
    keys = ranks * total + y
    at = np.searchsorted(probe, keys)
    at[at == len(probe)] = 0
    return int((probe[at] == keys).sum())


def merge_skip(lists: list[list[int]], wanted: int) -> Iterator[tuple[int, int]]:
    """(value, number of lists with it) for the values in at least ``wanted`` of the ascending lists.

    A heap holds the head of each list. When the least head is in too few
    lists, so many heads are popped that only larger values can still reach
    the number wanted, and their lists skip to the new least head.
    """
    heap = [(values[0], k, 0) for k, values in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= wanted and heap:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= wanted:
            yield value, len(popped)
            target = value + 1
        else:
            while heap and len(popped) < wanted - 1:
                popped.append(heapq.heappop(heap))
            target = max(value + 1, heap[0][0]) if heap else value + 1
            if not heap and len(popped) < wanted:
                return
        for _, k, at in popped:
            values = lists[k]
            at = at + 1 if target == value + 1 and values[at] == value else bisect_left(values, target, at)
            if at < len(values):
                heapq.heappush(heap, (values[at], k, at))


class Segments:
    """Size classes and their numbers of segments for one threshold."""

    def __init__(self, percent: int):
        self.percent, self.bounds, self.known = percent, [1], {}

    def class_of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, 100 * b // self.percent + 1))
        return bisect_left(self.bounds, n + 1) - 1

    def scheme(self, c: int) -> tuple[int, int, int]:
        """(K, T, E) of class ``c``: K segments; sets that link agree on T or more that are not empty, if one of them has at most E empty ones.

        (0, 0, 0) where no two different sets of the class can link.
        """
        if c not in self.known:
            self.class_of(self.bounds[-1])
            while len(self.bounds) < c + 2:
                self.class_of(self.bounds[-1])
            largest, least = self.bounds[c + 1] - 1, self.bounds[max(0, c - 1)]
            differ = (100 - self.percent) * 2 * largest // (100 + self.percent)
            wanted = 2 + differ // 12
            empty = 2
            for _ in range(20):
                k = differ + wanted + empty
                empty = int(1.4 * k * np.exp(-least / k)) + 2
            self.known[c] = (differ + wanted + empty, wanted, empty) if differ else (0, 0, 0)
        return self.known[c]

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The signatures (int64) of a sorted set, and T by the parity of the class.

        The lowest bit of a signature is the parity of the class it is for.
        A set with more empty segments than E signs these as well: only two
        such sets can agree on empty ones alone.
        """
        own, out, need = self.class_of(len(s)), [], [0, 0]
        u = np.sort(s.view(np.uint64))
        for c in (own, own + 1):
            k, wanted, empty = self.scheme(c)
            need[c % 2] = wanted
            if not k or self.percent * self.bounds[c] > 100 * len(s):
                continue
            segment = (u >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            with np.errstate(over="ignore"):
                mixed = np.add.reduceat(finalize(u), first)
                if k - len(first) > empty:
                    vacant = np.setdiff1d(np.arange(k, dtype=np.uint64), segment[first])
                    need[c % 2] = 1
                    out.append(finalize(finalize(vacant + np.uint64(c) * MIX) ^ np.uint64(0xE)) & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(c % 2))
                mixed = finalize(mixed ^ finalize(segment[first] + np.uint64(c) * MIX))
            out.append(mixed & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(c % 2))
        return (np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)), need


def _describe(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, segments, given = TaskContext.get().partitionId() << 40, Segments(percent), set()
        for batch in batches:
            for i, j, words in text_blocks(batch.column("text")):
                keys, sizes, signs, needs = [], [], [], []
                for s in shingle_sets(words, k):
                    key = _digest(s)
                    keys.append(key)
                    sizes.append(len(s))
                    if key in given or not len(s):  # equal sets sign once a task
                        sign, need = np.zeros(0, np.int64), [0, 0]
                    else:
                        sign, need = segments.sign(s)
                        if len(given) >= REMEMBER:
                            given.clear()
                        given.add(key)
                    signs.append(sign)
                    needs.append(need)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in signs])]).astype(np.int32)
                flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
                need = np.array(needs, np.int32).reshape(-1, 2)
                columns = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_key")]
                numbers = [pa.array(np.arange(row, row + j - i)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(need[:, 0]), pa.array(need[:, 1])]
                yield pa.RecordBatch.from_arrays([*columns, *numbers, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "text_key", "row", "key", "n", "need0", "need1", "signs"])
                row += j - i

    return run


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sign, row) sorted by sign: the rows whose sign another row has too. Only the last row is held between batches."""
    sign, row, matched = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if batch.num_rows:
            sign, row = (np.concatenate([held, batch.column(c).to_numpy()]) for held, c in ((sign, "sign"), (row, "row")))
            same = np.concatenate([[matched], sign[1:] == sign[:-1]])  # as the row before; for the held row that is known
            keep = same[:-1] | same[1:]
            yield pa.RecordBatch.from_arrays([pa.array(sign[:-1][keep]), pa.array(row[:-1][keep])], names=["sign", "row"])
            sign, row, matched = sign[-1:], row[-1:], bool(same[-1])
    if matched:
        yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(row)], names=["sign", "row"])


def _edges(percent: int):
    """From (sign, n, node, need, gone, long, easy) sorted: edges (a, b, side, wanted) with the components of all pairs of short lists and of the forests of long ones.

    A pair must be found ``wanted`` times on its side. A pair with an easy row
    need only be found once, so it needs no counting: easy rows make a chain,
    the others are tied to the easy rows next to them, with 0 wanted. Only
    pairs without an easy row are counted. All rows of a long list are easy.
    Between batches the last short list or the last row of a long one is held.
    """
    columns = ("sign", "n", "node", "need", "gone", "long", "easy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [np.zeros(0, np.int64)] * len(columns), 0  # pairs of rows before ``first`` are out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, columns, strict=True)]
            sign, n, node, need, gone, long, easy = rows
            at, total = np.arange(len(sign)), len(sign)
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(easy == 1, at, -1))[:-1]])
            after = np.minimum.accumulate(np.where(easy == 1, at, total)[::-1])[::-1]
            tied, hard = before >= 0, np.flatnonzero(easy == 0)
            ahead = hard[after[hard] < total]
            low, high, free = [before[tied], ahead], [at[tied], after[ahead]], int(tied.sum()) + len(ahead)
            for by in range(1, len(hard)):
                x, y = hard[:-by], hard[by:]
                same = sign[x] == sign[y]
                if not same.any():
                    break
                low.append(x[same])
                high.append(y[same])
            x, y = np.concatenate(low), np.concatenate(high)
            wanted = np.maximum(need[x], need[y]) - np.maximum(gone[x], gone[y])
            wanted[:free] = 0
            fits = (sign[x] == sign[y]) & (100 * n[x] >= percent * n[y]) & (y >= first)
            x, y, wanted = x[fits], y[fits], wanted[fits]
            ends = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(sign[x] & 1), pa.array(wanted)], names=["a", "b", "side", "wanted"])
            keep = total - 1 if long[-1] else int(np.searchsorted(sign, sign[-1]))
            held = [column[keep:] for column in rows]
            first = len(held[0])

    return run


def _full_sets(k: int):
    """Rows whose set is the node's: (block, chunk, chunks, node, n, shingles), each node once a task."""

    def run(batches):
        given: set[int] = set()
        for batch in batches:
            keys, nodes = batch.column("key").to_pylist(), batch.column("node").to_pylist()
            for i, j, words in text_blocks(batch.column("text")):
                at, lists = [], []
                for r, s in zip(range(i, j), shingle_sets(words, k), strict=True):
                    if nodes[r] not in given and _digest(s) == keys[r]:
                        given.add(nodes[r])
                        at.append(r)
                        lists.append(s)
                if len(given) >= REMEMBER:
                    given.clear()
                sizes = np.array([len(s) for s in lists], np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("block", "chunk", "chunks", "node")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["block", "chunk", "chunks", "node", "n", "shingles"])

    return run


def _search(percent: int):
    """From sets sorted by task (block, i, j): the links found, as (a, b); sets with the same ``label`` count as united."""

    def flush(nodes, sets, labels):
        at = sorted({node: i for i, node in enumerate(nodes)}.values())
        if len({labels[i] for i in at}) < 2:
            return
        found = search_block(np.array([nodes[i] for i in at], np.int64), [sets[i] for i in at], percent, np.array([labels[i] for i in at], np.int64))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        task, nodes, sets, labels = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j")), strict=True))
            ids, marks = batch.column("node").to_pylist(), batch.column("label").to_pylist()
            lists = batch.column("shingles")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for r, key in enumerate(keys):
                if key != task:
                    if len(nodes) > 1:
                        yield from flush(nodes, sets, labels)
                    task, nodes, sets, labels = key, [], [], []
                nodes.append(ids[r])
                labels.append(marks[r])
                sets.append(flat[offsets[r] : offsets[r + 1]].copy())
        if len(nodes) > 1:
            yield from flush(nodes, sets, labels)

    return run


def _searched(tasks: DataFrame, percent: int, name: str) -> DataFrame:
    """The links (a, b) of a table (block, i, j, node, label, shingles) of tasks."""
    arranged = tasks.select("block", "i", "j", "node", "label", "shingles").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node")
    return materialize(arranged.mapInArrow(_search(percent), "a long, b long"), name)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles long, component_id long) for each row of ``docs``.

    * Words are runs outside ``\\x20`` and ``\\x09-\\x0D``, A-Z lower-cased; a text with
      fewer than ``k`` words has its word sequence as its only shingle; one
      without words, or a null, has none and links with nothing.
    * Rows link when 100 * intersection >= percent * union; ``component_id`` is
      the least doc_id reachable by links, the row's own included.
    * Repeated rows, equal texts and equal sets are one component. An empty
      table gives an empty result. Other columns of ``docs`` are ignored.
    * Rows with a null doc_id count in links but never name a component; ids may
      repeat, on equal or different texts.
    * ``chunk_sets`` and ``chunk_shingles`` bound a search task, not the result.
    """
    return _classes(docs, k, percent, id_col, text_col, chunk_sets, chunk_shingles).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """(doc_id, text_key, n, component_id) for each row."""
    tune(docs.sparkSession)
    base = slim(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    signed = materialize(base.mapInArrow(_describe(k, percent), "doc_id long, text_key long, row long, key binary, n int, need0 int, need1 int, signs array<long>"), "jaccard-signed")
    rows = materialize(signed.select("doc_id", "text_key", "row", "key", "n", "need0", "need1", (F.size("signs") > 0).alias("signs")), "jaccard-rows")
    of_key = rows.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.max("need0").alias("need0"), F.max("need1").alias("need1"))
    nodes = materialize(of_key, "jaccard-nodes")
    blocks = components(_candidates(signed, rows, nodes, percent), "jaccard-blocks")
    blocks = materialize(blocks, "jaccard-blocks")
    links = _block_links(base, rows, nodes, blocks, k, percent, chunk_sets, chunk_shingles)
    found = components(links, "jaccard-links")
    # merged, never broadcast: these tables grow with the rows, and the sizes of their packed files say little about the memory a driver would need
    named = nodes.join(found.hint("merge"), "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = named.join(lowest.hint("merge"), "root").select("key", "component_id")
    return rows.select("doc_id", "text_key", "key", "n").join(of_key.hint("merge"), "key", "left").select("doc_id", "text_key", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def _candidates(signed: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link between nodes. The table of signatures is deleted once it is used."""
    postings = signed.select("row", F.explode("signs").alias("sign")).repartition(F.col("sign")).sortWithinPartitions("sign")
    shared = postings.select("sign", "row").mapInArrow(_shared, "sign long, row long")
    names = rows.where("signs").select("row", "key").join(nodes.hint("merge"), "key").select("row", "node", "n", "need0", "need1")
    need = F.when(F.expr("sign & 1") == 1, F.col("need1")).otherwise(F.col("need0"))
    lists = materialize(shared.join(names, "row").select("sign", "node", "n", need.alias("need")).distinct(), "jaccard-lists")
    discard(signed)
    # T occurrences: signatures that another node has too, counted for each class the node signed for
    length = lists.groupBy("sign").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("most")).where("c > 1")
    long = F.col("c") > LONG_LIST
    own = Window.partitionBy("node", F.expr("sign & 1"))
    lists = lists.join(length, "sign").withColumns({"long": long, "found": F.count(F.lit(1)).over(own), "need": F.max("need").over(own), "place": F.row_number().over(own.orderBy(F.desc("c"), "sign"))})
    lists = lists.withColumn("gone", F.least(F.col("need") - 1, F.count_if("long").over(own))).where("found >= need AND NOT (long AND place < need)")
    # with a row that is so often in long lists, one more list is enough for any other row of this one
    easy = F.col("long") | (F.col("gone") >= F.col("most") - 1)
    arranged = lists.select("sign", "n", "node", "need", "gone", F.col("long").cast("int").alias("long"), easy.cast("int").alias("easy")).repartition(F.col("sign")).sortWithinPartitions("sign", "n", "node")
    pairs = arranged.mapInArrow(_edges(percent), "a long, b long, side long, wanted long").groupBy("a", "b", "side").agg(F.count(F.lit(1)).alias("c"), F.min("wanted").alias("wanted"))
    return pairs.where("c >= wanted").select("a", "b")


def _block_links(base: DataFrame, rows: DataFrame, nodes: DataFrame, blocks: DataFrame, k: int, percent: int, chunk_sets: int, chunk_shingles: int) -> DataFrame:
    """Links (a, b) whose components are those of all links."""
    inside = nodes.join(blocks.select("node", F.col("root").alias("block")).hint("merge"), "node")
    # only large blocks, which are few, need a look-up
    weight = inside.groupBy("block").agg(_chunks(F.count(F.lit(1)), F.sum("n"), chunk_sets, chunk_shingles).alias("chunks")).where("chunks > 1")
    inside = inside.join(weight, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # a node is found again by its id and its text: ids may be null or repeat
    where = rows.select(F.col("row").alias("node"), "doc_id", "text_key")
    members = inside.join(where.hint("merge"), "node").select("doc_id", "text_key", "key", "node", "block", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    match = base["doc_id"].eqNullSafe(members["doc_id"]) & (base["text_key"] == members["text_key"])
    texts = base.join(members, match).select("text", "key", "block", "chunk", "chunks", "node")
    sets = materialize(texts.mapInArrow(_full_sets(k), "block long, chunk int, chunks int, node long, n int, shingles array<long>"), "jaccard-sets")
    small, large = sets.where("chunks = 1").withColumn("label", F.col("node")), sets.where("chunks > 1")
    none = F.lit(0)
    if not large.limit(1).count():
        links = _searched(small.select("block", none.alias("i"), none.alias("j"), "node", "label", "shingles"), percent, "jaccard-near")
        discard(sets)
        return links
    whole = large.select("node", "n", "shingles").join(_narrowed(large, percent).hint("merge"), "node")
    weight = whole.groupBy("block").agg(_chunks(F.count(F.lit(1)), F.sum("n"), chunk_sets, chunk_shingles).alias("chunks"))
    whole = materialize(whole.join(weight, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "jaccard-large")
    core, left = _by_difference(whole, percent)
    parts = left.groupBy("block").agg(_chunks(F.count(F.lit(1)), F.sum("n"), chunk_sets, chunk_shingles).alias("parts"))
    left = left.join(parts, "block").select("node", "label", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"))
    large = materialize(whole.select("block", "node", "n", "shingles").join(left.hint("merge"), "node"), "jaccard-left")
    discard(whole)
    first = small.select("block", none.alias("i"), none.alias("j"), "node", "label", "shingles").unionByName(large.select("block", "i", none.alias("j"), "node", "label", "shingles"))
    links = _searched(first, percent, "jaccard-near").unionByName(core)
    cut = large.where("parts > 1")
    if cut.limit(1).count():
        links = links.unionByName(_between_chunks(cut, links, percent, chunk_sets, chunk_shingles))
    discard(large)
    discard(sets)
    return links


def _narrowed(large: DataFrame, percent: int) -> DataFrame:
    """(node, block) for the sets of large blocks that can link at all, in blocks drawn anew that hold every link.

    Sets that link share one of the rarest |x| - least + 1 shingles of each, by
    the counts of the old block, where least is the overlap that x needs with
    any partner. Shingles that no other set has count among these.
    """
    every = large.select("block", "node", "n", F.explode("shingles").alias("s"))
    frequent = every.groupBy("block", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("block", "node")
    known = every.join(frequent, ["block", "s"]).withColumns({"found": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("c", "s"))})
    least = F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    none = F.lit(0)
    rare = known.where(F.col("place") <= F.col("found") - least + 1).select(F.xxhash64("block", "s").alias("sign"), "n", "node", none.alias("need"), none.alias("gone"), F.lit(1).alias("long"), F.lit(1).alias("easy"))
    edges = rare.repartition(F.col("sign")).sortWithinPartitions("sign", "n", "node").mapInArrow(_edges(percent), "a long, b long, side long, wanted long")
    return materialize(components(edges, "jaccard-narrow").select("node", F.col("root").alias("block")).distinct(), "jaccard-narrow")


def _by_difference(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of large blocks that need no search, and the sets (block, node, n, label) that still need one.

    Let p be the shingles that more than half of a block's sets hold, and let x
    differ from p by d(x) shingles, m(x) of them missing in x. Two sets overlap
    in |p| - m(x) - m(y) shingles and the c in which they differ alike, so they
    link just when 2 * (100 + percent) * c >= g(x) + g(y) with
    g(x) = 2 * percent * |x| + (100 + percent) * (2 * m(x) - |p|).
    Where g(x) + g(y) <= 0 they link whatever c is: the set with the least g
    gathers a core so. And c is at most the number of x's differences that
    another set of the block has too, and likewise for y: a set leaves where
    this number, or g, is too small or large for any partner outside the core.
    """
    weigh = large.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.max("chunks").alias("chunks"))
    frequent = large.select("block", F.explode("shingles").alias("s")).groupBy("block", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    frequent = materialize(frequent, "jaccard-frequent")
    most = frequent.join(weigh, "block").where("2 * c > sets").groupBy("block").agg(F.collect_list("s").alias("p"), F.collect_list(F.when(F.expr("sets - c > 1"), F.col("s"))).alias("often"))
    nothing = F.array().cast("array<long>")
    pivot = weigh.join(most, "block", "left").select("block", F.coalesce("p", nothing).alias("p"), F.coalesce("often", nothing).alias("often"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    g = 2 * percent * F.col("n").cast("long") + (100 + percent) * (2 * F.size(F.array_except("p", "shingles")) - F.size("p"))
    coded = large.join(pivot, ["block", "chunk"]).select("block", "node", "n", g.alias("g"), F.size(F.array_except("often", "shingles")).alias("absent"), F.array_except("shingles", "p").alias("added"))
    added = coded.select("block", "node", "n", "g", "absent", F.explode_outer("added").alias("s")).join(frequent, ["block", "s"], "left")
    alike = F.max("absent") + F.count("c")
    state = added.groupBy("block", "node").agg(F.first("n").alias("n"), F.first("g").alias("g"), (2 * (100 + percent) * alike).alias("most"))
    state = materialize(state.select("block", "node", "n", "g", (F.col("most") - F.col("g")).alias("room")), "jaccard-state")
    discard(frequent)
    # a pair can link only if g of each is at most the room of the other
    least = state.groupBy("block").agg(F.min("g").alias("low"), F.min(F.struct("g", "node")).alias("z"), F.max("room").alias("high"))
    state = state.join(least, "block").withColumn("in", F.expr("g + low <= 0"))
    core = state.where("in AND node <> z.node").select(F.col("node").alias("a"), F.col("z.node").alias("b"))
    able = state.where("in OR (g <= high AND low <= room)")
    outer = able.where("NOT in").groupBy("block").agg(F.min("g").alias("outer_low"), F.max("room").alias("outer_high"))
    left = able.join(outer, "block").where("NOT in OR (g <= outer_high AND outer_low <= room)")
    return materialize(core, "jaccard-core"), materialize(left.select("block", "node", "n", F.when(F.col("in"), F.col("z.node")).otherwise(F.col("node")).alias("label")), "jaccard-able")


def _chunks(count, shingles, chunk_sets: int, chunk_shingles: int):
    """Into how many chunks so many sets with so many shingles go."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(chunk_sets)), F.ceil(shingles / F.lit(chunk_shingles))).cast("int")


def _between_chunks(large: DataFrame, links: DataFrame, percent: int, chunk_sets: int, chunk_shingles: int) -> DataFrame:
    """Links between the chunks of blocks that have several, given those within chunks."""
    dealt = F.pmod(F.xxhash64("node", F.lit("dealt")), F.col("parts")).cast("int")
    none = F.lit(0)
    plain = large.select("block", "node", "n")

    def labelled(found: DataFrame) -> DataFrame:
        roots = components(found, "jaccard-labels")
        return materialize(plain.dropDuplicates(["node"]).join(roots, "node", "left").select("block", "node", "n", F.coalesce("root", "node").alias("label")), "jaccard-labels")

    # a few members of each component, searched together
    first = labelled(links)
    some = first.groupBy("block", "label", F.pmod(F.xxhash64("node"), F.lit(DELEGATES)).alias("d")).agg(F.min(F.struct("node", "n")).alias("m")).select("block", "label", "m.*")
    parts = some.groupBy("block").agg(_chunks(F.count(F.lit(1)), F.sum("n"), chunk_sets, chunk_shingles).alias("parts"))
    tasks = some.join(parts, "block").select("node", "label", dealt.alias("i"), none.alias("j")).join(large.select("block", "node", "shingles"), "node")
    second = _searched(tasks, percent, "jaccard-delegates")
    # what is still apart: the sets outside a block's largest component against those inside, and among themselves
    now = labelled(links.unionByName(second))
    sizes = now.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    most = sizes.groupBy("block").agg(F.max(F.struct("s", "c", "label")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("m.c < c")
    half_sets, half_shingles = max(1, chunk_sets // 2), max(1, chunk_shingles // 2)
    most = most.select(
        "block", F.col("m.label").alias("largest"), _chunks(F.col("m.c"), F.col("m.s"), half_sets, half_shingles).alias("inner"), _chunks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"), half_sets, half_shingles).alias("outer")
    )
    apart = now.join(most, "block").withColumn("in", F.col("label") == F.col("largest"))
    apart = apart.withColumn("parts", F.when(F.col("in"), F.col("inner")).otherwise(F.col("outer"))).withColumn("at", dealt)
    every_outer, every_inner = F.sequence(none, F.col("outer") - 1), F.sequence(none, F.col("inner") - 1)
    # tasks (i, j): chunk i of the inside (0 and up) with group j of the outside, or groups -1 - i and j of the outside
    inner = F.transform(every_outer, lambda j: F.struct(F.col("at").alias("i"), j.alias("j")))
    outer = F.concat(
        F.transform(every_inner, lambda i: F.struct(i.alias("i"), F.col("at").alias("j"))),
        F.transform(every_outer, lambda j: F.struct((-1 - F.least(j, F.col("at"))).alias("i"), F.greatest(j, F.col("at")).alias("j"))),
    )
    tasks = apart.select("node", "label", F.explode(F.when(F.col("in"), inner).otherwise(outer)).alias("t")).select("node", "label", "t.i", "t.j")
    third = _searched(tasks.join(large.select("block", "node", "shingles"), "node"), percent, "jaccard-apart")
    return second.unionByName(third)


def nearest_kept(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group stays, with all its columns.

    Rows with a null id stay, and rows without words (a null or empty text) do;
    rows with the id that names a group stay where their text is in it, repeated
    ones alike. An empty table gives an empty result; other columns may have any
    names.
    """
    gone_id, gone_key, key = free_names(docs, "gone_id", "gone_key", "text_key")
    gone = _classes(docs, k, percent, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return marked.join(gone, (F.col(f"`{id_col}`").cast("long") == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti").drop(key)
