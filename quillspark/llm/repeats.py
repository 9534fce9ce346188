"""Repeated passages, removed byte by byte: suffix arrays over what may repeat.

Each window of `length` bytes is dealt by the hash of its lowest k-gram, which it holds wherever it occurs. Neighbouring
windows with one lowest gram form a stretch, and equal windows can only be in stretches of one gram. Stretches with a gram
that occurs once are settled, and so are stretches that occur twice as a whole. Of the others, one text for each different
stretch goes to a task with all others of its gram. There the stretches are cut into phrases at grams that their content
chooses, phrases are ranked, and the suffix array of the phrase sequence, with common prefixes in bytes, tells which windows
occur twice.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut
from quillspark.llm.passages import shared_passages
from quillspark.llm.shingles import BASE, lowest, mixed
from quillspark.llm.suffixes import suffix_array

#: Bytes of the grams that deal windows, of those that cut stretches into phrases, and of a phrase, about.
GRAM, HEAD, PHRASE = 96, 16, 32
#: Bytes of texts that a worker deals together, and of which it hashes the grams at once; rows that it turns to objects.
PART, CHUNK, ROWS = 1_000_000, 1 << 18, 256
#: Bytes of stretches in a task, about, and stretches of one gram that are compared there. Windows of a gram with more are
#: counted one by one instead.
TASK_BYTES, CROWD = 2_000_000, 8192
_ODD = np.uint64(0x9FB21C651E98DF25)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    back = pow(BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(CHUNK + 2 * GRAM, b, np.uint64)))) for b in (BASE, back))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k neighbouring bytes."""
    (up, down), out = _powers(), np.empty(max(0, len(buf) - k + 1), np.uint64)
    for lo in range(0, len(out), CHUNK):
        part = buf[lo : lo + CHUNK + k - 1]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])))
        out[lo : lo + CHUNK] = mixed((total[k:] - total[:-k]) * down[: len(total) - k])
    return out


def stretches(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of `length` bytes with the same lowest k-gram: text, first and last start, and that gram's
    place and hash. Of equal grams the first is taken."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(0, sizes - length + 1)
    if not windows.any():
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(sizes) - sizes
    h = gram_hashes(buf, k)
    key = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=np.uint64)
    place = (lowest(key, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows - first, windows)
    place = place[at]
    edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    last, own = np.append(edge[1:], len(at)) - 1, owner[edge]
    return own, at[edge] - first[own], at[last] - first[own], place[edge] - first[own], h[place[edge]]


def common_prefixes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from a on equal those from b on, `limit` at most."""
    padded = np.concatenate((buf, np.zeros(16, np.uint8)))
    n = len(buf) + 8
    eight = np.empty(n, np.uint64)
    for k in range(8):
        part = padded[k : k + (n - k + 7) // 8 * 8]
        part = np.concatenate((part, np.zeros(-len(part) % 8, np.uint8)))
        eight[k::8] = np.frombuffer(part.tobytes(), np.uint64)[: len(eight[k::8])]
    same, left = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0)
    while len(left):
        differ = eight[a[left] + same[left]] ^ eight[b[left] + same[left]]
        some = differ != 0
        ended, low = left[some], differ[some]
        same[ended] += np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
        left = left[~some]
        same[left] += 8
        left = left[same[left] < limit[left]]
    return np.minimum(same, limit)


def repeated_windows(strings: list[bytes], whole: np.ndarray, heads: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each string, its runs (first, last start) of windows of `length` bytes that also start elsewhere.

    whole: strings that occur more than once; theirs aren't told again. heads: place in each string of a gram that all its
    windows hold and all strings with equal windows have. A phrase goes from a head or a gram whose hash is chosen to the end
    of the next one's, so that no phrase begins with another one, and the order of phrase ranks is that of bytes. A window
    is known by the bytes before its first chosen gram and by what follows from there on.
    """
    buf = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    h = gram_hashes(buf, HEAD)
    chosen = (h % np.uint64(PHRASE) == 0) | np.isin(h, np.unique(h[starts + heads]))
    cuts = np.flatnonzero(chosen)
    owner = np.searchsorted(stops, cuts, "right")
    inside = cuts + HEAD <= stops[owner]
    cuts, owner = cuts[inside], owner[inside]
    final = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(final, stops[owner], np.append(cuts[1:], 0) + HEAD)
    data = buf.tobytes()
    phrases = [data[a:b] for a, b in zip(cuts.tolist(), ends.tolist())]
    rank = {p: i + 1 for i, p in enumerate(sorted(set(phrases)))}
    sequence = np.zeros(len(cuts) + len(strings), np.int64)
    at = np.arange(len(cuts)) + owner  # a lowest symbol stands between strings
    sequence[at] = [rank[p] for p in phrases]
    back = np.full(len(sequence), -1, np.int64)
    back[at] = np.arange(len(cuts))
    order = back[suffix_array(sequence.tolist())]
    order = order[order >= 0]
    place = np.empty(len(cuts), np.int64)
    place[order] = np.arange(len(cuts))
    room = np.minimum(stops[owner] - cuts, length)[order]
    shared = common_prefixes(buf, cuts[order[:-1]], cuts[order[1:]], np.minimum(room[:-1], room[1:]))

    initial = np.concatenate(([True], owner[1:] != owner[:-1]))
    most = cuts - np.where(initial, starts[owner], np.concatenate(([0], cuts[:-1] + 1)))  # bytes before a cut that windows may hold
    least = np.maximum(0, cuts + length - stops[owner])
    again, tails = np.zeros(len(buf), bool), np.zeros(len(cuts), np.uint64)
    live = np.flatnonzero(most >= least)
    back = 0
    while len(live):
        told = live[least[live] <= back]
        if len(told):
            alike = np.concatenate(([0], np.cumsum(shared < length - back))).astype(np.uint64)
            key = mixed(tails[told] + alike[place[told]] * _ODD)
            by = np.argsort(key)
            twin = key[by][1:] == key[by][:-1]
            again[cuts[told[by]] - back] = np.append(twin, False) | np.append(False, twin)
        back += 1
        live = live[most[live] >= back]
        tails[live] = mixed(tails[live] * np.uint64(BASE) + buf[cuts[live] - back].astype(np.uint64) + np.uint64(1))

    found: list[list[tuple[int, int]]] = [[] for _ in strings]
    again[np.repeat(whole, sizes)] = False
    edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2] - 1
    own = np.searchsorted(stops, first, "right")
    for i, a, b, s in zip(own.tolist(), first.tolist(), last.tolist(), starts[own].tolist()):  # no window starts near a string's end
        found[i].append((a - s, b - s))
    return found


def _spans(values: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in v] for v in values], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            yield batch.slice(lo, ROWS)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, a number of the row, and the compressed text of each row, written: texts move three times."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_raw"))
    return cut(texts.mapInArrow(pack, "doc_id long, packed binary").withColumn("row", F.monotonically_increasing_id()))


def _dealt(base: DataFrame, length: int, gram: int) -> DataFrame:
    """All stretches: row, first and last start, place of the gram in the stretch, gram and content (hashes)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[int, int, bytes]] = []

        def told() -> pa.RecordBatch:
            texts = [t for _, _, t in held]
            own, first, last, place, h = stretches(texts, length, gram)
            names, shift = np.array([r for r, _, _ in held], np.int64)[own], np.array([s for _, s, _ in held], np.int64)[own]
            digest = lambda s: int.from_bytes(hashlib.md5(s).digest()[:8], "little", signed=True)
            content = [digest(texts[i][a : b + length]) for i, a, b in zip(own.tolist(), first.tolist(), last.tolist())]
            columns = [pa.array(x) for x in (names, first + shift, last + shift, (place - first).astype(np.int32), h.view(np.int64))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.int64())], ["row", "first", "last", "head", "gram", "content"])

        size = 0
        for batch in _slices(batches):
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unpack.decompress(packed)
                for a in range(0, len(text) - length + 1, PART):  # very long texts go in parts whose windows don't overlap
                    held.append((row, a, text[a : a + PART + length - 1]))
                    size += len(held[-1][2])
                    if size >= PART:
                        yield told()
                        held, size = [], 0
        if held:
            yield told()

    return base.select("row", "packed").mapInArrow(deal, "row long, first long, last long, head int, gram long, content long")


def _texts_of(base: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The text of each chosen stretch, with its gram, content, head and n."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            for packed, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unpack.decompress(packed)
                for a in range(0, len(marks), 1024):
                    part = marks[a : a + 1024]
                    names = ("gram", "content", "head", "n")
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([m[c] for m in part], pa.int32() if c == "head" else pa.int64()) for c in names], pa.array([text[m["first"] : m["last"] + length] for m in part], pa.binary())],
                        [*names, "text"],
                    )

    marks = chosen.groupBy("row").agg(F.collect_list(F.struct("gram", "content", "head", "n", "first", "last")).alias("marks"))  # bounded by the text
    return base.join(marks, "row").select("packed", "marks").mapInArrow(fetch, "gram long, content long, head int, n long, text binary")


def _by_suffixes(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    def settle(table: pa.Table) -> pa.Table:
        strings, whole = table.column("text").to_pylist(), np.array(table.column("n").to_pylist()) > 1
        found = repeated_windows(strings, whole, np.array(table.column("head").to_pylist(), np.int64), length)
        some = pa.array([i for i, f in enumerate(found) if f], pa.int64())
        return pa.table({"gram": table.column("gram").take(some), "content": table.column("content").take(some), "spans": _spans([f for f in found if f])})

    dealt = texts.withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInArrow(settle, "gram long, content long, spans array<struct<a: int, b: int>>")


def _one_by_one(texts: DataFrame, length: int) -> DataFrame:
    """As _by_suffixes, for stretches of grams that very many others share: a row for each window, counted by its hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, content, n, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "n", "text"))):
                k = len(text) - length + 1
                hashes = [hashlib.md5(text[i : i + length]).digest() for i in range(k)]
                columns = [pa.array([gram] * k, pa.int64()), pa.array([content] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(hashes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "content", "n", "a", "window"])

    found = cut(texts.mapInArrow(windows, "gram long, content long, n long, a int, window binary"))
    twice = found.groupBy("window").agg(F.sum("n").alias("_n")).where("_n > 1").select("window")
    told = found.where("n = 1").join(twice, "window").groupBy("gram", "content").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("spans"))
    return told


def repeated_spans(base: DataFrame, length: int, gram: int = GRAM, crowd: int = CROWD, task_bytes: int = TASK_BYTES) -> DataFrame:
    """row and spans, the starts (first, last) of its windows that also start elsewhere."""
    dealt = cut(_dealt(base, length, gram))
    # Written, so that the join below has nothing but rows on either side and Spark can split a frequent gram.
    often = cut(dealt.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram"))
    dealt = cut(dealt.join(often, "gram", "left_semi"))
    at = ("row", "first", "last", "head")
    different = cut(dealt.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(F.struct(*at)).alias("at")).select("gram", "content", "n", "at.*"))
    shared = different.groupBy("gram").agg(F.count("*").alias("_m"), F.sum(F.col("last") - F.col("first") + length).alias("_bytes")).where("_m > 1")
    shared = cut(shared)
    total, most = shared.agg(F.sum("_bytes"), F.max("_m")).first()
    whole = different.where("n > 1").select("gram", "content", F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).cast("int").alias("b"))).alias("spans"))
    if total:
        few = different.join(shared.where(F.col("_m") <= crowd).select("gram"), "gram")
        whole = whole.unionByName(_by_suffixes(_texts_of(base, few, length), math.ceil(total / task_bytes), length))
        if most > crowd:
            many = different.join(shared.where(F.col("_m") > crowd).select("gram"), "gram")
            whole = whole.unionByName(_one_by_one(_texts_of(base, many, length), length))
    found = dealt.join(whole, ["gram", "content"]).select("row", "first", F.explode("spans").alias("x"))
    start = F.col("first") + F.col("x.a")
    return found.groupBy("row").agg(F.collect_list(F.struct(start.alias("a"), (F.col("first") + F.col("x.b")).alias("b"))).alias("spans"))  # bounded by the text


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = False, words: int | None = None, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) of each text without the bytes
    that a string of `length` bytes covers which also starts anywhere else, in the same text or another.

    Texts are their UTF-8; what is left may end within a character. Overlapping repeats count; all are judged on the input.
    Null texts are empty, texts shorter than `length` stay whole; equal texts long enough go whole; rows stay as they are,
    repeated or not; extra columns are ignored; an empty table gives an empty result.
    With words, the column shared_passage is 1 where a text has that many words in a row which another row has too, be they
    of fewer bytes than `length` or with other white space, and else 0; nothing is removed for it.
    """
    base = _packed(docs)
    shared = None if words is None else shared_passages(base, words)
    spans = repeated_spans(base, length, **limits)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            rows = []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                text, parts, removed, runs, stop = unpack.decompress(packed), [], 0, 0, -1
                for x in sorted(found or [], key=lambda x: x["a"]):
                    a, b = x["a"], x["b"] + length
                    if a > stop:
                        runs += 1
                        parts.append(text[max(0, stop) : a])
                        removed += b - a
                        stop = b
                    elif b > stop:
                        removed += b - stop
                        stop = b
                kept = b"".join([*parts, text[max(0, stop) :]])
                rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            told = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *told[: 4 + keep_text], *batch.columns[3:]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text + ", shared_passage int" * (words is not None)
    names = [c.split()[0] for c in schema.split(", ")]
    marked = base.join(spans, "row", "left")
    if words is None:
        return marked.select("doc_id", "packed", "spans").mapInArrow(strip, schema)
    told = F.lit(0) if shared is None else F.coalesce("shared_passage", F.lit(0))
    if shared is not None:
        marked = marked.join(shared.withColumn("shared_passage", F.lit(1)), "row", "left")
    return marked.select("doc_id", "packed", "spans", told.alias("shared_passage")).mapInArrow(strip, schema)
