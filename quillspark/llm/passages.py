"""Passages of many words that different texts share, though they may be short in bytes.

Each window of `words` words is dealt by its lowest run of RUN words, which it holds wherever it occurs; neighbouring windows
with one such run are a stretch. Only windows whose run occurs in several rows are looked at, by their hashes: first those
that a task has at hand, then one of each different window of a task meets those of all others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut
from quillspark.llm.jaccard_join import _maybe
from quillspark.llm.shingles import lowest, mixed, run_hashes, word_hashes

#: Words of the runs that deal windows; bytes of texts that are hashed together, and of windows in a task, about.
RUN, PART, TASK_BYTES = 16, 1_000_000, 1_000_000
_blank, _word = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+")


def parts(text: bytes, words: int, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, of which each window of `words` words is in exactly one."""
    a, b = 0, size
    while b < len(text) and (m := _blank.search(text, b)):
        at = [x.start() for x in _word.finditer(text, a, m.start())]
        if len(at) >= words:
            yield text[a : m.start()]
            a = at[1 - words] if words > 1 else m.start()
        b = m.start() + size
    yield text[a:]


def stretches(texts: list[bytes], words: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of `words` words with the same lowest run of `run` words: its hash, the text, where each
    one's windows begin (and where the last one's end), and the hashes of all windows."""
    h, counts = word_hashes(texts)
    if len(h) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(owner[: len(h) - words + 1] == owner[words - 1 :])
    low, windows, own = lowest(run_hashes(h, run), words - run + 1)[at], run_hashes(h, words)[at], owner[at]
    edge = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])))) if len(at) else at
    return low[edge], own[edge], np.append(edge, len(at)), windows


def in_several(windows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with a window that another row has too; where each different window is, and the lowest of its rows."""
    if not len(windows):
        return rows, np.zeros(0, np.int64), rows
    order = np.argsort(windows)
    w, r = windows[order], rows[order]
    edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    lo, hi = np.minimum.reduceat(r, edge), np.maximum.reduceat(r, edge)
    return np.unique(r[np.repeat(lo < hi, np.diff(np.append(edge, len(w))))]), order[edge], lo


def _dealt(base: DataFrame, words: int, run: int, size: int, whole: bool) -> DataFrame:
    """All stretches: v (their run of words), row and, if whole, the hashes of their windows, eight bytes each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[int, bytes]] = []

        def told() -> pa.RecordBatch:
            low, own, begin, windows = stretches([t for _, t in held], words, run)
            columns = [pa.array(low.view(np.int64)), pa.array(np.array([r for r, _ in held], np.int64)[own])]
            if whole:
                columns.append(pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((begin * 8).astype(np.int32)), pa.py_buffer(windows)]))
            return pa.RecordBatch.from_arrays(columns, ["v", "row", "windows"][: 2 + whole])

        held_bytes = 0
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts(unpack.decompress(packed.as_py()), words, size):
                    held.append((row, part))
                    held_bytes += len(part)
                    if held_bytes >= size:
                        yield told()
                        held, held_bytes = [], 0
        if held:
            yield told()

    return base.select("row", "packed").mapInArrow(deal, "v long, row long" + ", windows binary" * whole)


def shared_passages(base: DataFrame, words: int, run: int = RUN, size: int = PART, task_bytes: int = TASK_BYTES) -> DataFrame | None:
    """The rows of base (row, packed text) with a run of `words` words that another row has too; None if there are none.

    Words are runs without white space, which itself may differ. Windows are alike if their hashes of 64 bits are.
    """
    often = _dealt(base, words, run, size, False).groupBy("v").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n"))
    often = cut(often.where("lo < hi").select("v", "n"))
    total = often.agg(F.sum("n")).first()[0]
    if not total:
        return None
    buckets = math.ceil(total * (words - run + 2) / 2 * 16 / task_bytes)  # a stretch has half of the windows around its run

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("windows").to_pylist()
            sizes, windows = [len(b) // 8 for b in blobs], np.frombuffer(b"".join(blobs), np.uint64)
            known, at, rows = in_several(windows, np.repeat(np.array(batch.column("row")), sizes))
            # By their run, not one by one: so a text meets as few buckets as it has stretches, however many there are.
            bucket = np.repeat(mixed(np.array(batch.column("v")).view(np.uint64)) % np.uint64(buckets), sizes)[at].astype(np.int64)
            order = np.lexsort((rows, bucket))
            bucket, windows, rows = bucket[order], windows[at][order], rows[order]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(edge[1:], len(bucket))
            found = [(int(bucket[a]), windows[a:b].tobytes(), rows[a:b].tobytes()) for a, b in zip(edge, ends)]
            if len(known):
                found.append((int(known[0]) % buckets, b"", known.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "windows", "rows"])

    def settle(group: pa.Table) -> pa.Table:
        windows, rows = group.column("windows").to_pylist(), group.column("rows").to_pylist()
        met, known = (np.frombuffer(b"".join(r for r, w in zip(rows, windows) if bool(w) == some), np.int64) for some in (True, False))
        found, _, _ = in_several(np.frombuffer(b"".join(windows), np.uint64), met)
        return pa.table({"row": pa.array(np.union1d(found, known), pa.int64())})

    met = _maybe(_dealt(base, words, run, size, True), often).select("v", "row", "windows")
    gathered = met.mapInArrow(gather, "bucket long, windows binary, rows binary")
    return gathered.groupBy("bucket").applyInArrow(settle, "row long").distinct()
