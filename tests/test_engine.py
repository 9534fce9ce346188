import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.operators import tables as K
from quillspark.plans import archive_queries, catalogue
from quillspark.sources import readers
from tests.compare import compare

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["hybrid_search", "knn_filtered", "cost_breakdown", "metadata_sync", "heading_runs", "html_to_text", "gold_check", "semantic_cache"])
def test_queries_equal_sql(spark, name):
    compare(spark, DATA, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_first_of_texts_without_letters(spark, tmp_path):
    texts = ["…", "?!", "", None, "İstanbul 1", "istanbul, 1", "A-b", "a B", "K\u0000x", "\u212a x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = catalogue.oracle_sql()["dedupe_first"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, tmp_path / "none", lambda s, _: catalogue.queries()["dedupe_first"](s, str(tmp_path)), sql) == 5


def test_diversify_equals_a_greedy_pass(spark):
    r = random.Random(2)
    rows = [(i, w := f"w{r.randrange(9)}", f"a{int(w[1]) % 4}") for i in range(120)]
    for limit, caps in ((10, (3, 4)), (40, (3, 4)), (200, (2, 5))):
        works, authors, kept, rest = {}, {}, [], []
        for i, w, a in rows:
            if works.get(w, 0) < caps[0] and authors.get(a, 0) < caps[1]:
                works[w], authors[a] = works.get(w, 0) + 1, authors.get(a, 0) + 1
                kept.append(i)
            else:
                rest.append(i)
        found = R.diversify(spark.createDataFrame(rows, "rank long, work string, author string"), limit, *caps).orderBy("position").collect()
        assert [x["rank"] for x in found] == (kept + rest)[:limit]


def test_functions(spark):
    row = spark.range(1).select(
        X.fold(F.lit("Ærø ÉTÉ—Straße!")).alias("fold"), X.prompt_norm(F.lit("  Who \n was  it?! ")).alias("norm"), X.tags_of(F.lit(" a, b,A,, c ")).alias("tags"),
        X.fuzzy_match(F.lit("the monastery garden"), ["monastary"]).alias("near"), X.fuzzy_match(F.lit("the cat"), ["dog"]).alias("far"),
        X.period_of(F.lit(500)).alias("p500"), X.period_of(F.lit(499)).alias("p499"), X.dedupe_key(F.lit("…")).alias("k"),
    ).first()
    assert row["fold"] == "aero ete strasse" and row["norm"] == "who was it" and row["tags"] == ["a", "b", "c"]
    assert row["near"] and not row["far"] and (row["p499"], row["p500"]) == ("antiquity", "medieval") and row["k"].startswith("#")


def test_guarded(spark):
    passages = spark.createDataFrame([(1, "one"), (2, "two")], "id long, text string")
    refs = passages.select("id", X.text_hash(F.col("text")).alias("hash")).union(spark.createDataFrame([(2, "old"), (3, "gone")], "id long, hash string"))
    assert sorted((r["id"], r["lost"]) for r in K.guarded(refs, passages).collect()) == [(1, False), (2, False), (2, True), (3, True)]


def test_nearest_equals_every_distance(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8))
    v[40:60] = v[20:40]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = r.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]], int(label[i])) for i in range(300)], "id long, v array<double>, label int").repartition(7)
    for parameters, holds in (({}, lambda i, q: True), ({"apart": ("label",)}, lambda i, q: label[i] != label[q]), ({"alike": ("label",)}, lambda i, q: label[i] == label[q])):
        asked = rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("label").alias("q_label"))
        found = sorted((x["q"], x["rank"], x["id"]) for x in R.nearest(rows, asked, 9, **parameters).collect())
        want = [(q, n, i) for q in range(0, 300, 50) for n, i in enumerate(sorted((i for i in range(300) if holds(i, q)), key=lambda i: (round(1 - v[i] @ v[q], 6), i))[:9])]
        assert found == want
    assert R.nearest(rows, asked.limit(0), 9).count() == 0 and R.nearest(rows.limit(0), asked, 9).count() == 0


def test_cached_answers_need_enough_likeness(spark):
    def turned(cosine):
        return [cosine, (1 - cosine**2) ** 0.5]

    saved = spark.createDataFrame([(1, turned(0.951), 1, 1), (2, turned(0.949), 1, 2), (3, turned(0.99), 2, 3), (4, [1.0, 0.0], 1, 4)], "id long, v array<double>, scope int, self long")
    asked = spark.createDataFrame([(4, [1.0, 0.0], 1, 4)], "q long, qv array<double>, q_scope int, q_self long")
    assert [(x["id"], x["sim"]) for x in archive_queries.cached_answers(saved, asked).collect()] == [(1, 0.951)]


def test_rerank_keeps_the_order_if_the_scorer_fails(spark):
    rows = spark.createDataFrame([(0, "en", "no word"), (1, "en", "the cat"), (2, "xx", "katten"), (3, "en", None)], "rank int, lang string, text string")
    found = S.reranked(rows, {"en": "the cat", "sv": "katten"}).orderBy("rank").collect()
    assert [r["text"] for r in found] == ["the cat", "katten", "no word", None] and not any(r["degraded"] for r in found)

    def broken(pairs):
        raise RuntimeError("no model")

    found = S.reranked(rows, {"en": "the cat"}, broken).orderBy("rank").collect()
    assert [r["text"] for r in found] == ["no word", "the cat", "katten", None] and all(r["degraded"] and r["pair_score"] is None for r in found)


def test_embedded(spark):
    texts = spark.createDataFrame([(1, "one two"), (2, "two one"), (3, ""), (4, "three")], "id long, text string")
    v = {r["id"]: r["v"] for r in S.embedded(texts).collect()}
    assert v[1] == v[2] != v[4] and set(v[3]) == {0.0} and all(len(x) == 64 for x in v.values()) and abs(sum(x * x for x in v[4]) - 1) < 1e-9


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b'id,title\r\n1,"a, ""b"""\r\nx,c')
    assert [tuple(r) for r in readers.read_csv_catalog(spark, str(tmp_path / "c.csv"), "id int, title string").collect()] == [(1, 'a, "b"'), (None, "c")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/u.txt").write_bytes("é".encode())
    (tmp_path / "t/l.txt").write_bytes("é".encode("latin-1"))
    assert [r["text"] for r in readers.read_texts(spark, str(tmp_path / "t")).collect()] == ["é", "é"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "hello")
    zipped = spark.read.format("binaryFile").load(str(tmp_path / "z.zip"))
    spark.udtf.register("unzip", readers.Unzip)
    zipped.createOrReplaceTempView("zipped")
    assert [(r["name"], bytes(r["content"])) for r in spark.sql("select u.* from zipped, lateral unzip(content) u").collect()] == [("a.txt", b"hello")]
    works = spark.createDataFrame([("a", "x"), ("a", "y")], "id string, title string")
    with pytest.raises(ValueError, match="'x', 'y'"):
        readers.write_manifest(works, str(tmp_path / "m"))


def test_ranks_are_cut_ahead_of_the_shuffle(spark):
    rows = spark.range(0, 2000, 1, 4).selectExpr("id % 3 as q", "id", "(id * 37) % 101 as d")
    found = R.ranked(rows, ["d", "id"], ["q"], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    want = [(q, i, (i * 37) % 101, n) for q in range(3) for n, i in enumerate(sorted(range(q, 2000, 3), key=lambda i: ((i * 37) % 101, i))[:2])]
    assert sorted(want) == sorted(map(tuple, found.collect()))


def test_mentions_open_all_works_they_name(spark):
    rows = [(i, f"w{i:02d}", f"Author {i}", "Of it") for i in range(60)] + [(60, "w60", None, "Of Author"), (61, "w61", "Other", None)]
    passages = spark.createDataFrame(rows, "id int, work string, author string, title string")
    assert sorted(r["work"] for r in S.named_works(passages.union(passages), ["author", "of"]).collect()) == [f"w{i:02d}" for i in range(61)]
    assert S.named_works(passages, ["of", " It "]).count() == 0


@pytest.fixture(scope="module")
def many_works(tmp_path_factory):
    """Tables in which a mention names 90 works; works after the 40th in order have passages of their own."""
    folder = tmp_path_factory.mktemp("many")
    source = "CASE WHEN doc_id % 4 = 0 THEN 'src7' ELSE 'src' || (1200 + doc_id % 90) END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({source} AS source) FROM '/root/testdata/sf0.01/documents.parquet') TO '{folder}/documents.parquet'")
    duckdb.sql(f"COPY (FROM '/root/testdata/sf0.01/embeddings.parquet') TO '{folder}/embeddings.parquet'")
    return str(folder)


def uncut(name):
    """A query's SQL without its end at 40 named works."""
    sql = catalogue.oracle_sql()[name]
    assert sql.count(" ORDER BY work LIMIT 40") == 1
    return sql.replace(" ORDER BY work LIMIT 40", "")


def test_fused_branches_of_many_named_works(spark, many_works):
    compare(spark, many_works, catalogue.queries()["fused_branches"], uncut("fused_branches"))


def test_pool_histogram_of_many_named_works(spark, many_works):
    compare(spark, many_works, catalogue.queries()["pool_histogram"], uncut("pool_histogram"))
