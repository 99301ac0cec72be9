"""URL filter: a blocked Bloom filter before an exact hash join, in DataFrame operations only.

Listed entries are canonical URL prefixes, a host and a path. A URL fits an
entry when its host is the entry's or a subdomain of it and its path starts
with the entry's. A URL first asks for its host and the hosts above it: a
blocked Bloom filter of the listed hosts passes possible ones, and an exact join
gives the path lengths that are listed for each. For these it asks for canonical
keys of host and path prefix: a blocked Bloom filter of the listed keys (256 bits
a block, one probe of one block) passes possible hits, and an exact join on the
key removes false positives. Nothing of the list but its size reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Listed keys per block of 256 bits, about: 16 bits a key.
KEYS_PER_BLOCK = 16
#: Bits that a key sets in its block.
PROBES = 6
#: Blocks (40 bytes each) and listed entries are sent to every executor up to these numbers; above, they are shuffled.
BROADCAST_BLOCKS = 500_000
BROADCAST_ENTRIES = 100_000


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _depth(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """Which of 256 bits the key sets: one of each sixth of a second hash's bits."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]


def _words(key: Column) -> list[Column]:
    """The block of a single key, as four longs."""
    bits = _bits(key)
    out = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for b in bits:
            word = word.bitwiseOR(F.when(F.floor(b / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a table with a column ``key``; partial filters are OR-ed before the shuffle."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bloom_hit) for each row of ``pages``.

    ``listed`` has (host, path, verdict), all strings; hosts are lower-cased.
    The longest entry that fits wins, of equally long ones that with the longer
    host, then the lesser verdict (``allow`` before ``block``). A null path is
    empty; entries without a host are left out. Where none fits,
    ``rule`` is null and the verdict ``default``. ``bloom_hit`` says whether the
    Bloom filter passed a key of the row.

    * A null URL or one without ``://`` has an empty host and path and fits no entry.
    * Repeated rows get a row each; ids may be null or repeat; an empty table
      or an empty list is fine; other columns are ignored.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    urls = base.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    entries = listed.select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h <> ''")
    entries = entries.groupBy("h", "p").agg(F.min("v").alias("v"))
    hosts = entries.groupBy("h").agg(F.sort_array(F.collect_set(F.length("p"))).alias("lengths"))  # at most as many as the longest path has characters
    entries = entries.select(_key(F.col("h"), F.col("p")).alias("key"), F.col("h").alias("entry_host"), "v")
    count, depth = entries.count(), hosts.agg(F.max(_depth(F.col("h")))).first()[0] or 0
    # URLs are judged once each: equal ones are one row before anything is joined
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth)))), lambda d: F.array_join(F.slice(labels, -d, d), "."))
    asked = distinct.select("host", "path", F.explode(F.array_distinct(above)).alias("h"))
    asked = _possible(asked, "h", hosts.select(F.col("h").alias("key")), count)
    asked = asked.join(F.broadcast(hosts) if count <= BROADCAST_ENTRIES else hosts, "h")
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = asked.select("host", "path", "h", F.explode(lengths).alias("long")).select("host", "path", F.col("h").alias("entry_host"), _key(F.col("h"), F.substring(F.col("path"), F.lit(1), F.col("long"))).alias("key"))
    possible = _possible(keys, "key", entries.select("key"), count)
    exact = possible.join(F.broadcast(entries) if count <= BROADCAST_ENTRIES else entries, ["key", "entry_host"], "left")
    rank = F.when(F.col("v").isNotNull(), F.struct(F.length("key").alias("a"), F.length("entry_host").alias("b"), F.when(F.col("v") == "allow", 1).otherwise(0).alias("c"), F.col("key").alias("rule"), F.col("v").alias("verdict")))
    best = exact.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = urls.join(best.withColumn("bloom_hit", F.lit(True)), ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.coalesce("bloom_hit", F.lit(False)).alias("bloom_hit"))


def _possible(rows: DataFrame, column: str, listed: DataFrame, count: int) -> DataFrame:
    """``rows`` whose ``column`` the Bloom filter of the ``listed`` keys (key) passes; ``count`` is about their number."""
    blocks = max(1, count // KEYS_PER_BLOCK)
    probed = rows.withColumns({f"m{i}": w for i, w in enumerate(_words(F.col(column)))}).withColumn("block", _block(F.col(column), blocks))
    passes = F.lit(True)
    for i in range(4):
        passes = passes & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    filter_ = bloom_blocks(listed, blocks)
    return probed.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, "block").where(passes).select(*rows.columns)
