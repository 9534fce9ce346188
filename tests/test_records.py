"""Searches, projects, translations and plans: guards, versions and writers at once."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators.records import Records, plan_shape


@pytest.fixture
def records(spark, tmp_path):
    return Records(spark, str(tmp_path / "records"))


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame([(1, "en", "one"), (2, "en", "two"), (3, "sv", "tre"), (4, "fr", None), (5, "fr", "cinq")], "id long, lang string, text string")


SEARCH = "key long, prompt string, scope string, model string, passages array<struct<id: bigint, relevance: string>>, cost double, seconds double, v array<float>"


def test_searches(spark, records, passages):
    rows = [(1, " What is  it?", "", "m", [(1, "fits"), (2, ""), (9, "gone")], 0.1, 2.0, [1.0]), (2, "What is it", "genre=verse", "m", [], 0.0, 0.5, None), (3, "  ", "", "m", [], 0.0, 0.0, None)]
    saved = {r["key"]: r["slug"] for r in records.save_searches(spark.createDataFrame(rows, SEARCH), passages, 7).collect()}
    assert set(saved) == {1, 2} and len(set(saved.values())) == 2 and all(len(s) == 10 for s in saved.values())
    held = {r["slug"]: r for r in records.read("searches").collect()}
    first = held[saved[1]]
    assert first["prompt_norm"] == "what is it" == held[saved[2]]["prompt_norm"] and first["corpus_works"] == 7 and [p["hash"] is None for p in first["passages"]] == [False, False, True]
    assert {r["slug"]: r["passage_count"] for r in records.searches().collect()} == {saved[1]: 2, saved[2]: 0} and records.searches(1).count() == 1
    gone = records.forget_searches(spark.createDataFrame([(saved[1],), ("never",)], "slug string"))
    assert [r["slug"] for r in gone.collect()] == [saved[1]] and [r["slug"] for r in records.read("searches").collect()] == [saved[2]]
    version = records.store.version()
    assert records.forget_searches(spark.createDataFrame([("never",)], "slug string")).count() == 0 and records.store.version() == version
    assert records.read("searches", 1).count() == 2  # an earlier version is still whole


def test_answers(spark, records, passages):
    turned = lambda c: [c, (1 - c * c) ** 0.5]
    save = lambda rows: {r["key"]: r["slug"] for r in records.save_searches(spark.createDataFrame(rows, SEARCH), passages, 1).collect()}
    slug = save([(1, "What is it?", "", "m", [(1, "x"), (2, "y")], 0.0, 0.0, turned(1.0)), (2, "Other", "genre=verse", "m", [(1, "x")], 0.0, 0.0, turned(0.99)), (3, "Third", "", "n", [(2, "y")], 0.0, 0.0, turned(0.98)), (4, "Fourth", "", "m", [(2, "y")], 0.0, 0.0, turned(0.97))])
    slug |= {9: save([(9, "WHAT is it", "", "m", [(1, "x")], 0.0, 0.0, None)])[9]}
    ask = lambda rows, now=passages: {r["key"]: (r["slug"], r["how"], r["similarity"]) for r in records.answers(spark.createDataFrame(rows, "key long, prompt string, scope string, model string, v array<float>"), now).collect()}
    questions = [(1, "what is it ", "", "m", turned(0.0)), (2, "new", "", "m", turned(1.0)), (3, "new", "genre=verse", "m", turned(1.0)), (4, "new", "", "n", turned(0.9)), (5, "new", "", "m", turned(0.0)), (6, "what is it", "", "n", turned(0.0))]
    found = ask(questions)
    assert found[1] == (slug[9], "exact", 1.0) and found[2] == (slug[1], "near", 1.0) and found[3] == (slug[2], "near", 0.99) and set(found) == {1, 2, 3, 4}
    assert found[4][0] == slug[3] and abs(found[4][2] - (0.9 * 0.98 + (1 - 0.81) ** 0.5 * (1 - 0.98**2) ** 0.5)) < 1e-5
    changed = passages.withColumn("text", F.when(F.col("id") == 1, "changed").otherwise(F.col("text")))
    assert ask(questions, changed)[2] == (slug[1], "near", 1.0) and 3 not in ask(questions, changed) and 1 not in ask(questions, changed)  # the newest exact one has lost its passage
    assert sorted((r["slug"], r["id"], r["n"]) for r in records.hydrated(changed).collect()) == sorted([(slug[1], 2, 1), (slug[3], 2, 1), (slug[4], 2, 1)])


def test_projects(spark, records, passages):
    made = records.create_projects(spark.createDataFrame([(1, "  Self ", " about ", "a, A, b"), (2, "  ", "", ""), (3, "x" * 200, None, None)], "key long, title string, description string, tags string"))
    slug = {r["key"]: r["slug"] for r in made.collect()}
    assert set(slug) == {1, 3}
    told = {r["slug"]: r for r in records.projects().collect()}
    assert (told[slug[1]]["title"], told[slug[1]]["description"], told[slug[1]]["tags"]) == ("Self", "about", ["a", "b"]) and len(told[slug[3]]["title"]) == 120
    add = lambda rows: records.add_passages(spark.createDataFrame(rows, "project string, id long, prompt string, relevance string"), passages)
    add([(slug[1], 1, "q", None), (slug[1], 1, "q", None), (slug[1], 2, None, "r"), (slug[1], 99, "q", ""), (slug[1], 4, "no text", ""), ("nobody", 1, "q", "")])
    version = records.store.version()
    assert add([(slug[1], 1, "again", "x")]) == version  # what a project holds is left alone
    records.set_notes(spark.createDataFrame([(slug[1], 1, " mine "), (slug[1], 99, "none")], "project string, id long, note string"))
    changed = passages.withColumn("text", F.when(F.col("id") == 2, "TWO").otherwise(F.col("text")))
    rows = {r["id"]: r for r in records.contents(changed).collect()}
    assert (rows[1]["n"], rows[1]["note"], rows[1]["lost"], rows[1]["prompt"]) == (1, "mine", False, "q") and rows[2]["lost"] and rows[2]["n"] is None and set(rows) == {1, 2}
    records.update_projects(spark.createDataFrame([(slug[1], "Other", "", "z"), (slug[3], " ", "", ""), ("nobody", "t", "", "")], "slug string, title string, description string, tags string"))
    assert {r["slug"]: r["title"][:5] for r in records.projects().collect()} == {slug[1]: "Other", slug[3]: "xxxxx"}
    assert records.remove_passages(spark.createDataFrame([(slug[1], 2), (slug[1], 77)], "project string, id long")).count() == 1
    before = records.store.version()
    records.delete_projects(spark.createDataFrame([(slug[1],)], "slug string"))
    assert records.read("members").count() == 0 and [r["slug"] for r in records.projects().collect()] == [slug[3]]
    assert records.store.version() == before + 1 and records.read("members", before).count() == 1 and records.read("projects", before).count() == 2


def test_writers_at_once_keep_the_guards(spark, records, passages):
    slug = records.create_projects(spark.createDataFrame([(1, "p", "", "")], "key long, title string, description string, tags string")).first()["slug"]
    errors = []

    def write(k):
        try:
            records.add_passages(spark.createDataFrame([(slug, 1, f"by {k}", ""), (slug, 2, f"by {k}", "")], "project string, id long, prompt string, relevance string"), passages)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    held = records.read("members").collect()
    assert not errors and sorted(r["id"] for r in held) == [1, 2] and len({r["prompt"] for r in held}) == 1 and records.store.version() == 2


def test_translations_follow_their_texts(spark, records, passages, tmp_path):
    log = str(tmp_path / "log")

    def translate():
        def own(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [t.upper() for t in texts]

        return own

    ask = lambda rows: sorted(tuple(r) for r in records.translated(rows, "m", translate).collect())
    said = lambda: sorted(open(log).read().split())
    assert ask(passages) == [(1, "ONE", False), (2, "TWO", False), (5, "CINQ", False)]
    assert ask(passages.where("id < 3")) == [(1, "ONE", True), (2, "TWO", True)] and said() == ["cinq", "one", "two"]
    changed = passages.withColumn("text", F.when(F.col("id") == 2, "deux").otherwise(F.col("text")))
    assert ask(changed) == [(1, "ONE", True), (2, "DEUX", False), (5, "CINQ", True)] and said() == ["cinq", "deux", "one", "two"]
    assert records.read("translations").count() == 3


def test_plans_of_an_older_form_are_made_anew(spark, records):
    usable, calls = plan_shape(("en", "sv")), []
    good = json.dumps({"inScope": True, "queries": {"en": "a", "sv": "b"}})
    ask = lambda texts, plan: sorted((r["prompt"], r["plan"], r["cached"]) for r in records.planned(spark.createDataFrame([(t,) for t in texts], "prompt string"), "m", lambda: lambda prompts: [plan] * len(prompts), usable).collect())
    old = '{"queries": {"en": "a"}}'
    assert ask(["Why?"], old) == [("Why?", old, False)] and ask(["why", "WHY ?"], good) == [("WHY ?", good, False), ("why", good, False)]
    assert ask(["Why?", "who"], old) == [("Why?", good, True), ("who", old, False)] and records.read("plans").count() == 2 and not calls
    for bad in ("", "[1]", "{", '{"inScope": "x", "queries": {"en": "a", "sv": "b"}}'):
        assert not spark.range(1).select(F.coalesce(usable(F.lit(bad)), F.lit(False))).first()[0]
    records.forget_plans("other")
    assert records.read("plans").count() == 2
    records.forget_plans("m")
    assert records.read("plans").count() == 0


def test_documents_are_written_under_their_names(spark, tmp_path):
    from quillspark.functions.clean import file_name
    from quillspark.operators.archive import write_documents

    docs = spark.createDataFrame([("Vad är Jaget?", "# A\n\n> one"), ("??", "two"), (None, "three"), ("x", None)], "question string, body string")
    write_documents(docs, str(tmp_path / "out"), F.when(F.col("question").isNotNull(), file_name(F.col("question"), "md")), F.col("body"))
    found = {(r["file"], r["value"]) for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert found == {("vad-är-jaget.md", "# A\n\n> one\n"), ("search.md", "two\n")}


def test_contents_move_no_texts_unless_asked_for(spark, records, passages):
    named = records.create_projects(spark.createDataFrame([("a", "A", "", "")], "key string, title string, description string, tags string"))
    assert "Window" not in named._jdf.queryExecution().executedPlan().toString()  # written, not worked out again by who asks
    records.add_passages(named.select(F.col("slug").alias("project"), F.lit(1).cast("long").alias("id"), F.lit("").alias("prompt"), F.lit("").alias("relevance")), passages)
    now = passages.withColumn("text", F.concat("text", F.lit(" more")))
    assert [tuple(r) for r in records.contents(now).select("id", "lost", "text").collect()] == [(1, True, None)]
    plan = records.contents(passages).select("id", "lost")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :].split("\n")
    assert not any("sha2" in x for x in plan[: plan.index("Join")].split("\n")) and any("sha2" in x for x in join)
    assert [tuple(r) for r in records.contents(passages).select("id", "lost", "text").collect()] == [(1, False, "one")]
