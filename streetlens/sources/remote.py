"""Detection logs of a remote detector: each request's lines are read as they come, with patience while it is busy."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# How often a busy detector is asked again, and how long to wait when it doesn't say or says more.
TRIES, WAIT_S, LONGEST_S = 60, 10.0, 60.0
OUT = "clip_id bigint, at bigint, line string"
_ROWS = 1000


def _open(url: str, body: bytes | None, tries: int, timeout_s: float):
    """The answer to a request; a detector that is busy (503) is asked again after the time it names."""
    kind = {} if body is None else {"Content-Type": "application/octet-stream"}
    for _ in range(tries):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, data=body, headers=kind), timeout=timeout_s)  # noqa: S310
        except urllib.error.HTTPError as e:
            if e.code != 503:
                raise RuntimeError(f"{url} answered {e.code}") from None
            named = e.headers.get("Retry-After") or ""
            e.close()
            time.sleep(min(float(named) if named.replace(".", "", 1).isdigit() else WAIT_S, LONGEST_S))
    raise RuntimeError(f"{url} stayed busy {tries} times")


def lines(requests: DataFrame, tries: int = TRIES, timeout_s: float = 600.0) -> DataFrame:
    """(clip_id, at, line) of the logs that requests (clip_id, url, body) are answered with; a null body asks with GET.

    Lines are passed on in small batches, so a long log needs no memory of its own.
    Blank lines are left out. An answer without a footer is an error: the task is
    tried again by Spark, and what it gave before is not kept. An address that is
    not http or https is an error, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from one(r["clip_id"], r["url"], r["body"])

    def one(clip: int, url: str, body: bytes | None) -> Iterator[pa.RecordBatch]:
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"{url!r} is not an address of a detector")
        found: list[str] = []
        at, whole = 0, False
        with _open(url, body, tries, timeout_s) as answer:
            for raw in answer:
                line = raw.decode().rstrip("\r\n")
                if not line.strip():
                    continue
                whole = whole or json.loads(line).get("type") == "footer"
                found.append(line)
                if len(found) == _ROWS:
                    yield table(clip, at, found)
                    at, found = at + len(found), []
        if not whole:
            raise RuntimeError(f"the answer of {url} ended without a footer")
        if found:
            yield table(clip, at, found)

    def table(clip: int, at: int, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([clip] * len(found), pa.int64()), pa.array(range(at, at + len(found)), pa.int64()), pa.array(found, pa.string())], names=["clip_id", "at", "line"])

    return requests.selectExpr("CAST(clip_id AS bigint) AS clip_id", "url", "body").mapInArrow(run, OUT)
