"""Landing of what requests name: polite to each host, patient with those that are busy, resumable, failures as rows.

What fetches is a plug; this repository has none that goes to a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import host
from quillspark.sources.readers import decoded
from quillspark.sources.versioned import VersionedTable

LANDED = "id string, source string, url string, host string, status int, attempts int, waited double, content binary, error string, at timestamp"
#: Answers after which asking again may help.
BUSY = frozenset({408, 425, 429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Answer:
    status: int
    content: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Manners:
    """Seconds between two requests to a host; requests for one thing at most; seconds before the second, doubled for each
    further one; seconds that a host may ask to be left alone, at most."""

    pause: float = 1.0
    attempts: int = 4
    first: float = 1.0
    longest: float = 120.0


#: What makes a fetcher, from an address to an answer: called once a task. It may raise, which counts as being busy.
Maker = Callable[[], Callable[[str], Answer]]


def asked_to_wait(headers: dict[str, str], now: float) -> float | None:
    """Seconds that an answer's Retry-After names, as a number or as a date; None if it has none that can be read."""
    said = next((v.strip() for k, v in headers.items() if k.lower() == "retry-after"), "")
    if said.isdigit():
        return float(said)
    try:
        return max(0.0, parsedate_to_datetime(said).timestamp() - now)
    except (ValueError, TypeError, IndexError):
        return None


def fetched(requests: DataFrame, make: Maker, manners: Manners = Manners(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Outcome of each request (id, source, url): its content and status, or the status or error it ended with.

    The requests of a host are dealt to one task, which asks for one thing after another: that is what politeness means, so
    that a frequent host is no skew to be split. Rows without an address that has a host end with an error unasked.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, free = make(), {}
        for batch in batches:
            for lo in range(0, len(batch), 16):
                part = batch.slice(lo, 16)
                told = [_one(ask, url, name, free, manners, sleep) for url, name in zip(part.column("url").to_pylist(), part.column("host").to_pylist())]
                kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([t[i] for t in told], kind) for i, kind in enumerate(kinds)]], [*part.schema.names, "status", "attempts", "waited", "content", "error"])

    named = requests.select(F.col("id").cast("string").alias("id"), "source", "url", host(F.col("url")).alias("host"))
    dealt = named.repartition("host").sortWithinPartitions("host", "id")
    return dealt.mapInArrow(work, LANDED.removesuffix(", at timestamp")).withColumn("at", F.current_timestamp())


def _one(ask: Callable[[str], Answer], url: str | None, name: str | None, free: dict[str, float], manners: Manners, sleep: Callable[[float], None]) -> tuple:
    """(status, attempts, seconds waited, content, error) of one request; free: when each host may be asked again."""
    if not name:
        return None, 0, 0.0, None, "no address"
    waited, status, error = 0.0, None, ""
    for attempt in range(1, manners.attempts + 1):
        pause = free.get(name, 0.0) - time.monotonic()
        if pause > 0:
            sleep(pause)
            waited += pause
        backoff = manners.first * 2 ** (attempt - 1)
        try:
            answer = ask(url)
            status, error = answer.status, "" if answer.status < 400 else f"status {answer.status}"
        except Exception as e:  # whatever a fetcher raises, the other requests go on
            answer, status, error = None, None, f"{type(e).__name__}: {e}"
        free[name] = time.monotonic() + manners.pause
        if answer and status not in BUSY:
            return status, attempt, waited, answer.content if status < 400 else None, error or None
        wanted = asked_to_wait(answer.headers, time.time()) if answer else None
        if wanted is not None and wanted > manners.longest:
            return status, attempt, waited, None, f"{error}; asked to wait {wanted:.0f} s"
        free[name] = time.monotonic() + max(manners.pause, backoff if wanted is None else wanted)
    return status, manners.attempts, waited, None, error


class Landing:
    """The folder of what has landed, as a table with versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, LANDED)

    def land(self, requests: DataFrame, make: Maker, manners: Manners = Manners(), sleep: Callable[[float], None] = time.sleep) -> int:
        """Fetch what hasn't landed yet, of each id once, and replace its earlier failure; returns the version."""
        wanted = requests.where("id IS NOT NULL").dropDuplicates(["id"]).withColumn("id", F.col("id").cast("string"))
        pending = wanted.join(self.landed().select("id"), "id", "left_anti")
        return self.table.replace(fetched(pending, make, manners, sleep), ["id"]) if pending.limit(1).count() else self.table.version()

    def landed(self) -> DataFrame:
        return self.table.read().where("content IS NOT NULL")

    def failures(self) -> DataFrame:
        """id, source, url, status, attempts, error of what was asked for in vain."""
        return self.table.read().where("content IS NULL").select("id", "source", "url", "status", "attempts", "error")


def works_of(landed: DataFrame, readers: dict[str, Callable[[Column], Column]], checks: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """id, source, text, fault of what landed: by its source decoded, checked and stripped in one chain.

    readers: by source, from the decoded text to the work's. checks: by source, from the decoded text to a fault, empty if it
    has none; a text with a fault is null. A source without a reader is a fault.
    """
    raw = decoded(F.col("content"))
    text, fault = F.lit(None).cast("string"), F.lit("no reader")
    for source, own in readers.items():
        check = (checks or {}).get(source)
        found = F.coalesce(check(raw), F.lit("")) if check else F.lit("")
        fault = F.when(F.col("source") == source, found).otherwise(fault)
        text = F.when(F.col("source") == source, F.when(found == "", own(raw))).otherwise(text)
    return landed.select("id", "source", text.alias("text"), fault.alias("fault"))
