"""The search index: segments of postings that ingest adds, and commits that name those in force.

A segment holds the postings of one batch of works and never changes. A work that lands again or goes leaves a tombstone for
the segments that hold it; a merge writes the living postings of several segments as one. Each of these publishes a manifest
with the segments, the tombstones and the totals that scores take, and a search keeps to the manifest it has resolved.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.stems import Terms
from quillspark.sources.versioned import Conflict, Manifests, shared_folder

WORDS = r"[\p{L}\p{N}]+"
POSTINGS = "term string, id long, work string, tf int, dl int, places array<int>, segment string"
PACKED = "term string, id array<long>, work array<string>, dl array<int>, ends array<int>, places array<int>"
#: Bytes of texts that a worker takes apart together, and of packed postings that a task sorts: several times as many in memory.
SLICE, SORTED = 8_000_000, 24 << 20
WORKS = "work string, n long, said long, words long, segment string"
TOMBS = "work string, segment string"
#: Segments at which an index that ingest adds to is merged.
MANY = 16


def terms_of(text: Column) -> Column:
    """Plain words in small letters, for counts that need no folding."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def _rows(term: pa.Array, bounds: np.ndarray, ids: pa.Array, works: pa.Array, dl: pa.Array, ends: np.ndarray, places: pa.Array) -> pa.RecordBatch:
    """Packed postings: a row for each term, which holds the postings from one bound to the next. ends: where each posting's
    places end."""
    at, ends = pa.array(bounds, pa.int32()), np.append(0, ends)
    begin = ends[bounds]
    told = (ends[1:] - np.repeat(begin[:-1], np.diff(bounds))).astype(np.int32)
    held = [*[pa.ListArray.from_arrays(at, c) for c in (ids, works, dl, pa.array(told))], pa.ListArray.from_arrays(pa.array(begin, pa.int32()), places)]
    return pa.RecordBatch.from_arrays([term, *held], ["term", "id", "work", "dl", "ends", "places"])


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in columns that aren't empty."""
    return np.flatnonzero(np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of (id, work, text) with about SLICE bytes of text; a longer text goes alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def posted(texts: DataFrame) -> DataFrame:
    """Packed postings of (id, work, text): a row for each term of a slice of texts, with the texts that have it and its places
    there. Texts are taken apart, folded, stemmed and counted where they are, so that only these rows move, and frequent terms
    take few of them; a worker stems each distinct word once."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for part in _slices(batch):
                said = [terms.of(text or "") for text in part.column("text").to_pylist()]
                dl, codes = np.array([len(words) for words in said], np.int32), {}
                if n := int(dl.sum()):
                    code = np.fromiter((codes.setdefault(w, len(codes)) for words in said for w in words), np.int32, n)
                    order = np.argsort(code, kind="stable")  # by term, then text, then place
                    code, text = code[order], np.repeat(np.arange(len(dl), dtype=np.int32), dl)[order]
                    place = (np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(dl, dtype=np.int64) - dl, dl))[order].astype(np.int32)
                    first = _begins(code, text)
                    own = text[first]
                    yield _rows(pa.array(list(codes), pa.string()), np.append(_begins(code[first]), len(first)), part.column("id").take(pa.array(own)), part.column("work").take(pa.array(own)), pa.array(dl[own]), np.append(first[1:], n), pa.array(place))

    rows = texts.select(F.col("id").cast("long").alias("id"), F.col("work").cast("string").alias("work"), "text")
    return rows.mapInArrow(take_apart, PACKED)


def packed(postings: DataFrame) -> DataFrame:
    """Postings packed again: those that stand together by term, as files hold them, share a row."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                term = batch.column("term")
                first = _begins(pc.dictionary_encode(term).indices.to_numpy())
                places = batch.column("places")
                yield _rows(term.take(pa.array(first)), np.append(first, len(batch)), *batch.columns[1:4], np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False)), places.flatten())

    return postings.select("term", "id", "work", "dl", "places").mapInArrow(together, PACKED)


@dataclass(frozen=True)
class View:
    """An index at one commit."""

    spark: SparkSession
    path: str
    commit: dict

    def segments(self) -> list[str]:
        return self.commit.get("segments", [])

    def table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/{s}/{name}" for s in self.segments()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tombs(self) -> DataFrame:
        paths = [f"{self.path}/tombs/{t}" for t in self.commit.get("tombs", [])]
        return self.spark.read.schema(TOMBS).parquet(*paths) if paths else self.spark.createDataFrame([], TOMBS)

    def _living(self, rows: DataFrame) -> DataFrame:
        if not self.commit.get("tombs"):
            return rows
        dead = rows["work"].eqNullSafe(F.col("_work")) & (rows["segment"] == F.col("_segment"))
        return rows.join(self.tombs().select(F.col("work").alias("_work"), F.col("segment").alias("_segment")), dead, "left_anti")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Living postings, of these terms alone if given: the filter reaches the scan."""
        rows = self.table("postings", POSTINGS)
        return self._living(rows if terms is None else rows.where(F.col("term").isin(terms)))

    def works(self) -> DataFrame:
        return self._living(self.table("works", WORKS))

    def totals(self) -> tuple[int, float]:
        """Number of passages, and mean number of words of those with a text."""
        n, said, words = (self.commit.get("totals") or {}).get("sums", (0, 0, 0))
        return n, words / said if said else 0.0


@contextmanager
def _parts_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Meanwhile Spark balances shuffles by parts of so many bytes at most, so that tasks sort in memory whatever the input."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(name)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) > most:
        spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, held)


class Index:
    """The index of a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifests = Manifests(spark, path)

    def view(self, number: int | None = None) -> View:
        return View(self.spark, self.path, self.manifests.at(self.manifests.latest() if number is None else number))

    def _committed(self, commit: dict) -> dict:
        """commit with its totals, summed over works, of which there are far fewer than passages."""
        sums = View(self.spark, self.path, commit).works().agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "said", "words")]).first()
        return commit | {"totals": {"sums": list(sums)}}

    def _write(self, postings: DataFrame, segment: str) -> DataFrame:
        """Packed postings as a segment's, by term and sorted within files, so that a search reads the row groups of its terms
        alone. Rows are dealt by hash and balanced by Spark as it runs, which splits frequent terms; ranges would take the
        texts apart twice, once for a sample. They move and are sorted packed, and become one for each text as they are written."""
        path = f"{self.path}/segments/{segment}/postings"
        dealt = postings.hint("rebalance", "term").sortWithinPartitions("term")
        begins = F.slice(F.concat(F.array(F.lit(0)), "ends"), F.lit(1), F.size("ends")).alias("begin")
        rows = dealt.select("term", "places", F.inline(F.arrays_zip("id", "work", "dl", begins, F.col("ends").alias("end")))).withColumn("tf", F.col("end") - F.col("begin"))
        rows = rows.select("term", "id", "work", "tf", "dl", F.slice("places", F.col("begin") + 1, F.col("tf")).alias("places"), F.lit(segment).alias("segment"))
        with _parts_of(self.spark, SORTED):
            rows.write.option("parquet.block.size", 8 << 20).parquet(path)
        return self.spark.read.schema(POSTINGS).parquet(path)

    def _buried(self, view: View, works: DataFrame) -> str | None:
        """Tombstones for the living works that are named, as a new folder; None if none of them lives."""
        named = works.select(F.col("work").cast("string").alias("_named")).distinct()
        living = view.works().join(named, F.col("work").eqNullSafe(F.col("_named")), "left_semi").select("work", "segment")
        name = str(uuid.uuid4())
        living.write.parquet(f"{self.path}/tombs/{name}")
        return name if self.spark.read.schema(TOMBS).parquet(f"{self.path}/tombs/{name}").limit(1).count() else None

    def add(self, texts: DataFrame, stream: str = "", batch: int | None = None, works: DataFrame | None = None, note: dict | None = None) -> int:
        """Add the passages (id, work, text) of a batch of works; works that are there already are replaced, and those of
        `works` (work) too that have no passages any more.

        A null text is a passage without words, and a null work one like any other. With a batch number, a batch of the
        stream that has been added before is left out, so that one that runs again changes nothing. note: what else the
        commit tells, by name; it is kept until another commit tells it anew. Returns the commit's number.
        """
        done = lambda now: batch is not None and now.get("streams", {}).get(stream, -1) >= batch
        if done(self.view().commit):
            return self.manifests.latest()
        segment = str(uuid.uuid4())
        rows = texts.select(F.col("id").cast("long").alias("id"), F.col("work").cast("string").alias("work"), "text")
        words = self._write(posted(rows), segment).groupBy("work").agg(F.sum("tf").alias("words"))
        sizes = rows.groupBy("work").agg(F.count("*").alias("n"), F.count("text").alias("said"))
        sized = sizes.join(words.select(F.col("work").alias("_work"), "words"), F.col("work").eqNullSafe(F.col("_work")), "left")
        sized.select("work", "n", "said", F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.lit(segment).alias("segment")).write.parquet(f"{self.path}/segments/{segment}/works")
        added = self.spark.read.schema(WORKS).parquet(f"{self.path}/segments/{segment}/works")
        size = added.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

        def change(now: dict) -> dict | None:
            if done(now):
                return None
            gone = added.select("work") if works is None else works.select(F.col("work").cast("string").alias("work"))
            tomb = self._buried(View(self.spark, self.path, now), gone) if now.get("segments") else None
            commit = now | {"note": now.get("note", {}) | (note or {}), "sizes": now.get("sizes", {}) | {segment: size}, "segments": [*now.get("segments", []), segment], "tombs": [*now.get("tombs", []), *([tomb] if tomb else [])]}
            if batch is not None:
                commit["streams"] = now.get("streams", {}) | {stream: batch}
            return self._committed(commit)

        return self.manifests.commit(change)

    def remove(self, works: DataFrame) -> int:
        """Take the named works (work) out of all segments."""

        def change(now: dict) -> dict | None:
            tomb = self._buried(View(self.spark, self.path, now), works)
            return self._committed(now | {"tombs": [*now.get("tombs", []), tomb]}) if tomb else None

        return self.manifests.commit(change)

    def merge(self, least: int = 2, most: int | None = None) -> int:
        """Write the living postings of the `most` smallest segments, or of all, as one, if there are `least`.

        Merging all but the largest each time keeps what is written again within a logarithm of what was added. Tombstones go
        with the segments that they name. Where a work of theirs was replaced meanwhile, the merge is done again.
        """
        for _ in range(10):
            number = self.manifests.latest()
            before = self.manifests.at(number)
            if len(before.get("segments", [])) < max(2, least):
                return number
            sizes = before.get("sizes", {})
            chosen = sorted(before["segments"], key=lambda s: sizes.get(s, 0))[:most]
            rest, segment = [s for s in before["segments"] if s not in chosen], str(uuid.uuid4())
            view = View(self.spark, self.path, before | {"segments": chosen})
            self._write(packed(view.postings()), segment)
            view.works().withColumn("segment", F.lit(segment)).write.parquet(f"{self.path}/segments/{segment}/works")
            tombs = []
            if rest and before.get("tombs"):
                tombs = [str(uuid.uuid4())]
                view.tombs().where(F.col("segment").isin(rest)).write.parquet(f"{self.path}/tombs/{tombs[0]}")
            moved = False

            def change(now: dict) -> dict | None:
                nonlocal moved
                moved = now.get("tombs") != before.get("tombs") or not set(chosen) <= set(now["segments"])
                if moved:
                    return None
                kept = [s for s in now["segments"] if s not in chosen]
                sizes = {s: n for s, n in now.get("sizes", {}).items() if s in kept} | {segment: sum(before.get("sizes", {}).get(s, 0) for s in chosen)}
                return self._committed(now | {"segments": [*kept, segment], "tombs": tombs, "sizes": sizes})

            number = self.manifests.commit(change)
            if not moved:
                return number
        raise Conflict(self.path)


def index_for(spark: SparkSession, texts: DataFrame) -> View:
    """The index of passages that no ingest has indexed: written once for the state of the files they come from, and found
    again by any session that has the same shared folder (spark.checkpoint.dir)."""
    base = shared_folder(spark)
    jvm, state = spark.sparkContext._jvm, hashlib.sha256()
    for name in sorted(texts.inputFiles()):
        file = jvm.org.apache.hadoop.fs.Path(name)
        status = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file)
        state.update(f"{name}\n{status.getLen()}\n{status.getModificationTime()}\n".encode())
    index = Index(spark, f"{base}/index-{state.hexdigest()[:32]}")
    if not index.manifests.latest():
        index.add(texts, batch=0)  # whoever comes second adds nothing
    return index.view()


def phrases(words: list[str], most: int = 96) -> Counter:
    """Phrases (terms in a row) of a request's words, and how often each counts: split at blanks, without the signs of query
    languages, longer than two letters, the first `most`, each spelling once."""
    parts = [t for w in words for t in w.split()]
    bare = [t.translate({ord(c): None for c in '"*()^:-'}).strip() for t in parts]
    own = Terms()
    said = (tuple(own.of(t)) for t in dict.fromkeys([t for t in bare if len(t) > 2][:most]))
    return Counter(p for p in said if p)


def occurrences(view: View, wanted: list[tuple[str, ...]]) -> DataFrame:
    """phrase (its number), id, tf, dl of the passages that hold a phrase: its terms at neighbouring places."""
    hits = view.postings(sorted({t for p in wanted for t in p}))
    alone = {p[0]: n for n, p in enumerate(wanted) if len(p) == 1}
    number = F.lit(None).cast("int")
    for term, n in alone.items():
        number = F.when(F.col("term") == term, F.lit(n)).otherwise(number)
    found = hits.select(number.alias("phrase"), "id", "tf", "dl").where("phrase is not null")
    longer = {n: p for n, p in enumerate(wanted) if len(p) > 1}
    if longer:
        parts = hits.where(F.col("term").isin(sorted({t for p in longer.values() for t in p})))
        # A passage has a row for each of the request's terms at most.
        by = parts.groupBy("id", "segment").agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        none = F.array().cast("array<int>")

        def times(phrase: tuple[str, ...]) -> Column:
            at = [F.coalesce(F.try_element_at("at", F.lit(t)), none) for t in phrase]
            begun = [F.transform(here, lambda x: x - k) for k, here in enumerate(at)]  # where the phrase would begin
            return F.size(reduce(F.array_intersect, begun))

        told = by.select("id", "dl", F.explode(F.array(*[F.struct(F.lit(n).alias("phrase"), times(p).alias("tf")) for n, p in longer.items()])).alias("x"))
        found = found.unionByName(told.select("x.phrase", "id", "x.tf", "dl").where("tf > 0"))
    return found


def bm25(view: View, wanted: Counter, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the passages that hold a phrase; allowed: ids that may be found.

    Statistics are those of all passages, whatever is allowed, so that a filter doesn't change a passage's score. The term
    filter reaches the scan of the postings, which hold all that a score takes. A phrase that two spellings of the request
    share counts twice.
    """
    n, avgdl = view.totals()
    order = sorted(wanted)
    if not order:
        return view.spark.createDataFrame([], "id long, score double")
    hits = occurrences(view, order)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # one row for each phrase of the request
    if allowed is not None:
        hits = hits.join(allowed, "id", "left_semi")
    times = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (i, wanted[p])]), F.col("phrase"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = times * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    return hits.join(F.broadcast(df), "phrase").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
