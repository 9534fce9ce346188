"""Versioned tables, index segments, stems, ingest and vectors against plain Python."""

import math
import random
import re
import threading
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import stems
from quillspark.operators import index as I
from quillspark.operators import retrieval as R
from quillspark.operators.vectors import Vectors
from quillspark.sources.versioned import Manifests, VersionedTable
from quillspark.streaming.ingest import Library, ingest


def test_postings_move_packed(spark, tmp_path, monkeypatch):
    texts = [(i, f"w{i % 3}" if i % 5 else None, None if i % 7 == 0 else f"the bird {'a b ' * (i % 4)}x{i % 11} the") for i in range(60)]
    rows = spark.createDataFrame(texts, "id long, work string, text string").coalesce(1)
    assert I.posted(rows).where("term = 'the'").count() == 1  # one row, not one for each text
    monkeypatch.setattr(I, "SLICE", 300)
    batch = pa.RecordBatch.from_pylist([{"id": i, "work": w, "text": x} for i, w, x in [*texts, (60, "w", "a" * 999), (61, "w", "é")]])
    slices = [s.column("text").to_pylist() for s in I._slices(batch)]
    assert sum(slices, []) == batch.column("text").to_pylist() and len(slices) > 3
    assert all(len(s) == 1 or sum(len((x or "").encode()) for x in s) <= 300 for s in slices)
    want = []
    for i, work, text in texts:
        words = (text or "").split()
        want += [(w, i, work, words.count(w), len(words), [n for n, x in enumerate(words) if x == w]) for w in set(words)]
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, index = spark.conf.get(name), I.Index(spark, str(tmp_path))
    index.add(rows.where("id < 30"))
    index.add(rows.where("id >= 30"), works=rows.where("false").select("work"))
    for _ in range(2):
        found = index.view().postings().select("term", "id", "work", "tf", "dl", "places").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
        index.merge()
    assert len(index.view().segments()) == 1 and spark.conf.get(name) == before


def test_stems_of_the_published_examples():
    told = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
    hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
    vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
    triplicate triplic formative form formalize formal electriciti electr electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust
    replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular effective effect bowdlerize bowdler probate probat rate rate
    cease ceas roll roll generalizations gener oscillators oscil a a is is""".split()
    assert [stems.stem(w) for w in told[::2]] == told[1::2]


def test_spellings_meet():
    terms = stems.Terms()
    for a, b in (("Paris", "PARIS"), ("été", "ete"), ("l'homme", "L’Homme"), ("liberté", "LIBERTÉ"), ("running", "runs"), ("Sång", "sang"), ("philosophers", "Philosopher")):
        assert terms.of(a) == terms.of(b) != []
    assert terms.of("l'homme") == ["l", "homm"] and terms.of("_a_ x2 3") == ["a", "x2", "3"]
    small = stems.Terms(most=2)
    assert [small.of(t) for t in ("houses cats dogs houses",)] == [["hous", "cat", "dog", "hous"]]


TEXTS = {
    1: ("w1", "Paris est la ville de l'homme. L'été à Paris"), 2: ("w1", "The philosophers were running, he runs"), 3: ("w2", "homme l été"), 4: ("w2", None), 5: (None, "l homme, l'homme et LʼHOMME"),
    6: ("w3", ""), 7: ("w3", "the the the running of the houses in the house"), 8: ("w4", "Liberté, égalité"),
}


def plain_terms(text):
    words = re.findall(r"[^\W_][^\W_̀-ͯ]*(?:[̀-ͯ]+[^\W_̀-ͯ]*)*", text or "")
    return [stems.stem("".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))) for w in words]


def plain_bm25(texts, asked):
    said = {i: plain_terms(t) for i, (_, t) in texts.items()}
    spoken = [len(said[i]) for i, (_, t) in texts.items() if t is not None]
    mean, scores = sum(spoken) / len(spoken), Counter()
    for phrase, times in asked.items():
        tf = {i: sum(tuple(w[k : k + len(phrase)]) == phrase for k in range(len(w))) for i, w in said.items()}
        df = sum(n > 0 for n in tf.values())
        idf = max(1e-6, math.log((len(texts) - df + 0.5) / (df + 0.5)))
        for i, n in tf.items():
            if n:
                scores[i] += times * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(said[i]) / mean))
    return pytest.approx(dict(scores), abs=2e-6)


def found(view, words):
    return {r["id"]: r["score"] for r in I.bm25(view, I.phrases(words)).collect()}


def rows_of(spark, texts):
    return spark.createDataFrame([(i, w, t) for i, (w, t) in texts.items()], "id long, work string, text string")


QUESTIONS = (["Paris"], ["l'homme"], ["ete"], ["running", "runs"], ["LIBERTÉ", "the", "house"], ["été Paris", '"homme"*'], ["zzz"], ["of", "..."])


def test_scores_and_phrases(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "i"))
    assert index.view().totals() == (0, 0.0) and found(index.view(), ["Paris"]) == {}
    index.add(rows_of(spark, TEXTS))
    for words in QUESTIONS:
        assert found(index.view(), words) == plain_bm25(TEXTS, I.phrases(words)), words
    assert I.phrases(["running", "runs"]) == {("run",): 2} and I.phrases(['the "old" house*', "of house", "a-b(c)"]) == {("the",): 1, ("old",): 1, ("hous",): 1, ("abc",): 1}
    plan = index.view().postings(["homm"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,homm)" in plan or "PushedFilters: [In(term" in plan
    some = rows_of(spark, TEXTS).where("id = 3").select("id")
    assert [r["id"] for r in I.bm25(index.view(), I.phrases(["l'homme", "homme"]), some).collect()] == [3]


def test_segments_are_a_full_rebuild(spark, tmp_path):
    index, now, r = I.Index(spark, str(tmp_path / "i")), {}, random.Random(3)
    words = ["Paris", "homme", "l'homme", "running", "house", "été", "the"]
    for batch in range(7):
        if batch == 4:
            index.remove(spark.createDataFrame([("w1",), ("nobody",)], "work string"))
            now = {i: x for i, x in now.items() if x[0] != "w1"}
        elif batch == 5:
            before = index.view()
            index.merge()
            assert len(index.view().segments()) == 1 and not index.view().commit["tombs"]
            assert len(before.segments()) > 1 and found(before, ["Paris"]) == plain_bm25(now, I.phrases(["Paris"]))  # a reader keeps its commit
        else:
            works = r.sample(["w1", "w2", "w3", "w4", None], 2)
            new = {100 * batch + k: (r.choice(works), r.choice([None, " ".join(r.choice(words) for _ in range(r.randrange(9)))])) for k in range(9)}
            named = {w for w, _ in new.values()}
            now = {i: x for i, x in now.items() if x[0] not in named} | new
            index.add(rows_of(spark, new), "s", batch)
            number = index.manifests.latest()
            assert index.add(rows_of(spark, new), "s", batch) == number  # a batch that runs again
        if batch == 3:
            segments = index.view().segments()
            index.merge(2, 2)
            assert len(index.view().segments()) == len(segments) - 1 and len(set(index.view().segments()) & set(segments)) == len(segments) - 2
        for asked in QUESTIONS[:5]:
            assert found(index.view(), asked) == plain_bm25(now, I.phrases(asked)), (batch, asked)
        assert index.view().totals()[0] == len(now)


def test_manifests_are_published_once(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    assert m.latest() == 0 and m.at(0) == {} and m.publish(1, {"é": [1]}) and not m.publish(1, {"other": 1}) and m.at(1) == {"é": [1]} and m.latest() == 1
    assert m.commit(lambda now: None) == 1


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k long, v string")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    said = lambda n=None: sorted(map(str, (tuple(r) for r in t.read(n).collect())))
    assert said() == [] and t.append(rows((1, "a"), (2, "b"), (None, "n"))) == 1
    t.append(rows((3, "c")))
    assert t.replace(rows((2, "B"), (4, "d"), (None, "m")), ["k"]) == 3
    assert said() == sorted(["(1, 'a')", "(2, 'B')", "(3, 'c')", "(4, 'd')", "(None, 'm')", "(None, 'n')"]) and said(1) == sorted(["(1, 'a')", "(2, 'b')", "(None, 'n')"])
    kept = t.manifests.at(3)["parts"]
    t.delete(rows((1, "")), ["k"])
    assert "(1, 'a')" not in said() and len(set(t.manifests.at(4)["parts"]) & set(kept)) == len(kept) - 1  # parts without the key stay as they are
    t.rewrite(lambda df: df.where("k IS NOT NULL"))
    assert said() == ["(2, 'B')", "(3, 'c')", "(4, 'd')"] and len(t.manifests.at(5)["parts"]) == 1 and said(2) == sorted(["(1, 'a')", "(2, 'b')", "(3, 'c')", "(None, 'n')"])


def test_vacuum_spares_what_is_in_force(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k long")
    assert t.vacuum(seconds=0) == 0
    for k in range(4):
        t.append(spark.range(k, k + 1).toDF("k"))
    t.rewrite(lambda df: df.where("k > 0"))
    assert t.vacuum() == 0 and t.vacuum(keep=2, seconds=0) == 0  # the version before still names the old parts
    assert t.vacuum(seconds=0) == 4 and sorted(r["k"] for r in t.read().collect()) == [1, 2, 3]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k long, v string")
    errors = []

    def guarded(now, k):  # only one of the writers may add this key
        return spark.createDataFrame([(99, f"by {k}")], "k long, v string").join(now.where("k = 99"), "k", "left_anti")

    def write(k):
        try:
            t.append(spark.createDataFrame([(k, "x")], "k long, v string"))
            t.append(lambda now: guarded(now, k))
            t.replace(spark.createDataFrame([(50, f"{k}")], "k long, v string"), ["k"])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and t.version() == 12
    assert sorted(r["k"] for r in t.read().collect()) == [0, 1, 2, 3, 50, 99]
    sizes = [t.read(n).count() for n in range(13)]
    assert all(0 <= b - a <= 1 for a, b in zip(sizes, sizes[1:]))  # each version is whole


def test_ingest_publishes_works_once(spark, tmp_path):
    land, check = str(tmp_path / "land"), str(tmp_path / "check")
    library = Library(spark, str(tmp_path / "lib"))
    put = lambda rows: spark.createDataFrame(rows, "work_id long, lang string, text string").coalesce(1).write.mode("append").parquet(land)
    put([(1, "en", "one " * 40), (2, "en", "two " * 40), (None, "en", "nobody " * 40), (6, "en", "short")])
    ingest(library, land, check).awaitTermination()
    put([(3, "en", "three " * 40), (2, "en", "second " * 40)])
    ingest(library, land, check).awaitTermination()
    first = [r["text"] for r in library.edition().passages.collect()]
    assert sorted(t.split()[0] for t in first) == ["one", "three", "two"]  # finished works are skipped
    before = library.edition()
    ingest(library, land, str(tmp_path / "check2"), force=True).awaitTermination()  # all again, from another checkpoint
    now = library.edition()
    assert sorted(r["text"].split()[0] for r in now.passages.collect()) == ["one", "second", "three"] and now.index.works().count() >= 3
    assert {r["id"] >> 20 for r in I.bm25(now.index, I.phrases(["second"])).collect()} == {2} and not I.bm25(now.index, I.phrases(["two"])).count()
    assert sorted(r["text"].split()[0] for r in before.passages.collect()) == ["one", "three", "two"] and I.bm25(before.index, I.phrases(["two"])).count() == 1
    assert {r["id"] for r in now.vectors.collect()} == {r["id"] for r in now.passages.collect()}
    number = library.index.manifests.latest()
    assert library.publish(spark.createDataFrame([(1, "en", "x " * 99)], "work_id long, lang string, text string")) == number
    library.withdraw(spark.createDataFrame([(3,)], "work_id long"))
    left = library.edition()
    assert {r["work"] for r in left.passages.collect()} == {"1", "2"} == {r["work"] for r in left.vectors.collect()} and not I.bm25(left.index, I.phrases(["three"])).count()


def test_vectors_follow_their_texts(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        def embed(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [[float(len(t))] for t in texts]

        return embed

    v = Vectors(spark, str(tmp_path / "v"), f"lengths {tmp_path}", make)
    texts = lambda rows: spark.createDataFrame(rows, "id long, work string, text string")
    works = spark.createDataFrame([("a",), ("b",)], "work string")
    held = lambda: sorted((r["id"], r["v"][0]) for r in v.table.read().collect())
    said = lambda: sorted(open(log).read().split("\n")[:-1])
    v.refresh(texts([(1, "a", "x"), (2, "a", "yy"), (3, "b", "zzz"), (4, "b", None)]), works)
    assert held() == [(1, 1.0), (2, 2.0), (3, 3.0)] and said() == ["x", "yy", "zzz"]
    version = v.table.version()
    assert v.refresh(texts([(1, "a", "x"), (2, "a", "yy"), (3, "b", "zzz"), (4, "b", None)]), works) == version and said() == ["x", "yy", "zzz"]
    v.refresh(texts([(1, "a", "x"), (2, "a", "YYYY")]), works.where("work = 'a'"))
    assert held() == [(1, 1.0), (2, 4.0), (3, 3.0)] and said() == ["YYYY", "x", "yy", "zzz"]
    v.refresh(texts([]), works.where("work = 'b'"))
    assert held() == [(1, 1.0), (2, 4.0)]


@pytest.mark.parametrize("block", [1, 7, 16_384])
def test_blocks_of_queries(spark, block, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 23)
    monkeypatch.setattr(R, "COLUMNS", 4)
    r = np.random.default_rng(4)
    v = r.normal(size=(90, 5))
    v[40:60] = v[20:40]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = r.integers(0, 3, 90)
    rows = spark.createDataFrame([(int(i) * 2**40, [float(x) for x in v[i]], int(label[i])) for i in range(90)] + [(7, None, 1)], "id long, v array<double>, label int").repartition(5)
    asked = rows.where(f"id % {6 * 2**40} = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("label").alias("q_label"))
    got = sorted((x["q"], x["rank"], x["id"], x["d"]) for x in R.nearest(rows, asked, 9, apart=("label",), block=block).collect())
    want = []
    for q in range(0, 90, 6):
        near = sorted((int(np.rint((1 - v[i] @ v[q]) * 1e6)), i) for i in range(90) if label[i] != label[q])[:9]
        want += [(q * 2**40, n, i * 2**40, d / 1e6) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert R.nearest(rows, asked.limit(0), 9, block=block).count() == 0 and R.nearest(rows.limit(0), asked, 9, block=block).count() == 0
