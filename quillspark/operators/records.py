"""What users keep: searches, projects with passages, translations and plans, as tables of one store.

Writes are batches. Their guards are part of the transaction: they are checked against the version that they change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import prompt_norm, tags_of, text_hash
from quillspark.operators import archive as A
from quillspark.operators import retrieval as R
from quillspark.operators import tables as K
from quillspark.sources.versioned import Store

SCHEMAS = {
    "searches": "slug string, prompt string, prompt_norm string, scope string, model string, passages array<struct<id: bigint, hash: string, relevance: string>>, cost double, seconds double, corpus_works long, at timestamp, v array<float>",
    "projects": "slug string, title string, description string, tags array<string>, at timestamp",
    "members": "project string, id long, hash string, prompt string, relevance string, note string, at timestamp",
    "translations": "id long, hash string, model string, text string, cost double, at timestamp",
    "plans": "prompt_norm string, model string, prompt string, plan string, cost double, at timestamp",
}
#: Characters of a project's title and description at most.
TITLE, DESCRIPTION = 120, 500
#: Characters of a slug: hexadecimal digits of five random bytes.
SLUG = 10


class Records:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path, SCHEMAS)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.read(name, version)

    # Searches

    def save_searches(self, rows: DataFrame, passages: DataFrame, works: int) -> DataFrame:
        """Save answered searches (key, prompt, scope, model, passages: an array of structs id and relevance, cost, seconds, v), each
        with fingerprints of its passages (id, text) and its vector; returns key and slug. An empty prompt isn't saved; a
        passage that isn't there has a null fingerprint and so counts as lost later."""
        refs = rows.select("key", F.posexplode("passages").alias("_n", "p")).join(passages.select(F.col("id").alias("_id"), "text"), F.col("p.id") == F.col("_id"), "left")
        told = refs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_n", "p.id", text_hash(F.col("text")).alias("hash"), "p.relevance"))).alias("_refs"))
        kept = F.transform(F.coalesce("_refs", F.array().cast("array<struct<_n: int, id: bigint, hash: string, relevance: string>>")), lambda r: F.struct(r["id"].alias("id"), r["hash"].alias("hash"), r["relevance"].alias("relevance")))
        new = rows.join(told, "key", "left").where(F.trim("prompt") != "").withColumns({"passages": kept, "prompt_norm": prompt_norm(F.col("prompt")), "corpus_works": F.lit(works).cast("long"), "at": F.current_timestamp()})
        named = None

        def change(now: dict[str, DataFrame]) -> list[tuple]:
            nonlocal named
            named = self._slugged(new, now["searches"].select("slug"))
            return [("append", "searches", named)]

        self.store.transact(change)
        return named.select("key", "slug")

    def _slugged(self, rows: DataFrame, taken: DataFrame) -> DataFrame:
        """rows with a random slug that neither another row nor one of those taken (slug) has; written, so that they stay so and
        that who asks for them again doesn't work them out again."""
        code = F.left(F.sha2(F.expr("uuid()").cast("binary"), 256), F.lit(SLUG))
        coded = self._kept(rows.withColumn("_code", code).withColumn("_order", F.monotonically_increasing_id()))
        return self._kept(A.with_unique_slugs(coded, taken, "_code", "_order").drop("_code", "_order"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """rows written aside, so that random values in them stay as they are, and that what is read often is made once."""
        path = f"{self.store.manifests.path}/drafts/{self.spark.range(1).select(F.expr('uuid()')).first()[0]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def searches(self, limit: int | None = None) -> DataFrame:
        """Saved searches, the newest first: how many passages were chosen (those with a relevance), and what they cost."""
        rows = self.read("searches")
        chosen = F.size(F.filter("passages", lambda p: F.coalesce(p["relevance"], F.lit("")) != ""))
        found = rows.select("slug", "prompt", "scope", "model", "cost", "at", chosen.cast("long").alias("passage_count")).orderBy(F.desc("at"), "slug")
        return found if limit is None else found.limit(limit)

    def hydrated(self, passages: DataFrame) -> DataFrame:
        """slug, id, relevance, text, n of the chosen passages of saved searches that are still what they were, numbered from 1
        without gaps; passages (id, text)."""
        refs = self.read("searches").select("slug", F.posexplode("passages").alias("_at", "p")).where("coalesce(p.relevance, '') <> ''")
        rows = K.guarded(refs.select("slug", "_at", "p.id", "p.hash", "p.relevance"), passages).where("NOT lost")
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("_at", "id"))).select("slug", "id", "relevance", "text", "n")

    def answers(self, asked: DataFrame, passages: DataFrame, looked_at: int = 5, least: float = 0.95) -> DataFrame:
        """key, slug, how, similarity for questions (key, prompt, scope, model, v) that a saved search answers.

        The newest search with the same normal prompt, scope and model answers exactly. Without one, the nearest of the
        `looked_at` searches nearest to v does, if it is as near as `least` and has the same scope and model. Either must have
        a chosen passage that is still what it was. Others of the questions have no row.
        """
        usable = self.hydrated(passages).select("slug").distinct()
        saved = self.read("searches").withColumn("_id", F.xxhash64("slug"))
        own = asked.withColumn("_prompt", prompt_norm(F.col("prompt")))
        newest = saved.groupBy(F.col("prompt_norm").alias("_prompt"), "scope", "model").agg(F.max_by("slug", F.struct("at", "slug")).alias("slug"))
        exact = own.join(newest, ["_prompt", "scope", "model"]).join(usable, "slug", "left_semi").select("key", "slug", F.lit("exact").alias("how"), F.lit(1.0).alias("similarity"))
        rest = own.join(exact, "key", "left_anti").withColumn("_q", F.xxhash64("key"))
        near = R.nearest(saved.where("v IS NOT NULL").select(F.col("_id").alias("id"), "v"), rest.select(F.col("_q").alias("q"), F.col("v").alias("qv")), looked_at)
        near = near.where(1 - F.col("d") >= least).join(saved.select(F.col("_id").alias("id"), "slug", "scope", "model"), "id").join(usable, "slug", "left_semi")
        met = near.join(rest.select(F.col("_q").alias("q"), "key", "scope", "model"), ["q", "scope", "model"])
        first = met.groupBy("key").agg(F.min(F.struct("d", "rank", "slug")).alias("x"))
        return exact.unionByName(first.select("key", "x.slug", F.lit("near").alias("how"), F.round(1 - F.col("x.d"), 6).alias("similarity")))

    def forget_searches(self, slugs: DataFrame) -> DataFrame:
        """Delete searches (slug), each with its vector, and no passage; returns the slugs that were there."""
        return self._delete("searches", slugs.select("slug").distinct(), ["slug"])

    def _delete(self, name: str, keys: DataFrame, by: list[str]) -> DataFrame:
        gone, keys = None, self._kept(keys)

        def change(now: dict[str, DataFrame]) -> list[tuple]:
            nonlocal gone
            gone = now[name].join(keys, by, "left_semi").select(*by).distinct()
            return [("delete", name, keys, by)]

        self.store.transact(change)
        return gone

    # Projects

    def create_projects(self, rows: DataFrame) -> DataFrame:
        """Create projects (key, title, description, tags: comma-joined), trimmed and cut to what fits; one without a title isn't
        created. Returns key and slug."""
        new = rows.select("key", F.substring(F.trim("title"), 1, TITLE).alias("title"), F.substring(F.trim(F.coalesce("description", F.lit(""))), 1, DESCRIPTION).alias("description"), tags_of(F.coalesce("tags", F.lit(""))).alias("tags"))
        new = new.where("title <> ''").withColumn("at", F.current_timestamp())
        named = None

        def change(now: dict[str, DataFrame]) -> list[tuple]:
            nonlocal named
            named = self._slugged(new, now["projects"].select("slug"))
            return [("append", "projects", named)]

        self.store.transact(change)
        return named.select("key", "slug")

    def update_projects(self, rows: DataFrame) -> int:
        """Give projects (slug, title, description, tags) that exist other words; one without a title stays as it is."""
        told = rows.select("slug", F.substring(F.trim("title"), 1, TITLE).alias("title"), F.substring(F.trim(F.coalesce("description", F.lit(""))), 1, DESCRIPTION).alias("description"), tags_of(F.coalesce("tags", F.lit(""))).alias("tags"))
        told = told.where("title <> ''").dropDuplicates(["slug"])
        return self.store.transact(lambda now: [("replace", "projects", told.join(now["projects"].select("slug", "at"), "slug"), ["slug"])])

    def delete_projects(self, slugs: DataFrame) -> int:
        """Delete projects with what they hold, at once."""
        keys = self._kept(slugs.select("slug").distinct())
        return self.store.transact(lambda now: [("delete", "projects", keys, ["slug"]), ("delete", "members", keys.select(F.col("slug").alias("project")), ["project"])])

    def add_passages(self, rows: DataFrame, passages: DataFrame) -> int:
        """Put passages into projects (project, id, prompt, relevance), with the fingerprint of their text.

        Left out are those of no project, those that aren't among the passages (id, text), and those that a project holds
        already; one asked for twice counts once.
        """
        told = rows.join(passages.where("text IS NOT NULL").select("id", text_hash(F.col("text")).alias("hash")), "id").dropDuplicates(["project", "id"])
        blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
        new = told.select("project", "id", "hash", blank("prompt"), blank("relevance"), F.lit("").alias("note"), F.current_timestamp().alias("at"))

        def change(now: dict[str, DataFrame]) -> list[tuple]:
            known = new.join(now["projects"].select(F.col("slug").alias("project")), "project", "left_semi")
            fresh = self._kept(known.join(now["members"], ["project", "id"], "left_anti"))
            return [("append", "members", fresh)] if fresh.limit(1).count() else []

        return self.store.transact(change)

    def remove_passages(self, rows: DataFrame) -> DataFrame:
        """Take passages (project, id) out of projects; returns those that were in."""
        return self._delete("members", rows.select("project", "id").distinct(), ["project", "id"])

    def set_notes(self, rows: DataFrame) -> int:
        """Notes (project, id, note) of passages that projects hold."""
        told = rows.select("project", "id", F.trim("note").alias("note")).dropDuplicates(["project", "id"])
        return self.store.transact(lambda now: [("replace", "members", now["members"].drop("note").join(told, ["project", "id"]), ["project", "id"])])

    def projects(self) -> DataFrame:
        """Projects, the newest first, with how many passages they hold."""
        held = self.read("members").groupBy(F.col("project").alias("slug")).agg(F.count("*").alias("passage_count"))
        return self.read("projects").join(held, "slug", "left").withColumn("passage_count", F.coalesce("passage_count", F.lit(0))).orderBy(F.desc("at"), "slug")

    def contents(self, passages: DataFrame) -> DataFrame:
        """project, id, text, note, prompt, lost, n of what projects hold: in the order added, those whose text (id, text) is still
        the same numbered without gaps; the others are lost and have no number."""
        rows = K.guarded(self.read("members"), passages)
        place = F.row_number().over(Window.partitionBy("project", "lost").orderBy("at", "id"))
        return rows.select("project", "id", "text", "note", "prompt", "lost", F.when(~F.col("lost"), place).alias("n"))

    # Translations and plans

    def translated(self, passages: DataFrame, model: str, translate: Callable[[], Callable[[list[str]], list[str]]], cost: float = 0.0, home: str = "sv") -> DataFrame:
        """id, translation, cached of passages (id, lang, text). A translation is kept for a passage's text: one of another text
        counts as none and is replaced. What is in the home language, or null, has none. translate() is called once a task."""
        wanted = passages.where((F.col("lang") != home) & F.col("text").isNotNull()).select("id", "text", text_hash(F.col("text")).alias("hash")).dropDuplicates(["id"])
        kept = self.read("translations").select("id", "hash", F.col("text").alias("translation"))
        missing = wanted.join(kept, ["id", "hash"], "left_anti")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = translate()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(own(batch.column("text").to_pylist()), pa.string())], ["id", "hash", "translation"])

        told = self._kept(missing.mapInArrow(work, "id long, hash string, translation string").where(F.trim("translation") != ""))
        new = told.select("id", "hash", F.lit(model).alias("model"), F.col("translation").alias("text"), F.lit(cost).alias("cost"), F.current_timestamp().alias("at"))
        if told.limit(1).count():
            self.store.transact(lambda now: [("replace", "translations", new, ["id"])])
        both = kept.withColumn("cached", F.lit(True)).unionByName(told.withColumn("cached", F.lit(False)))
        return wanted.join(both, ["id", "hash"]).select("id", "translation", "cached")

    def planned(self, prompts: DataFrame, model: str, expand: Callable[[], Callable[[list[str]], list[str]]], usable: Callable[[Column], Column], cost: float = 0.0) -> DataFrame:
        """prompt, plan, cached of the prompts (prompt). A plan, JSON, is kept for a question's normal form and a model; one that
        isn't usable, of an older form, is made anew and replaced."""
        asked = prompts.select("prompt").distinct().withColumn("prompt_norm", prompt_norm(F.col("prompt")))
        kept = self.read("plans").where((F.col("model") == model) & F.coalesce(usable(F.col("plan")), F.lit(False))).select("prompt_norm", "plan")
        missing = asked.groupBy("prompt_norm").agg(F.min("prompt").alias("prompt")).join(kept, "prompt_norm", "left_anti")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = expand()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own(batch.column("prompt").to_pylist()), pa.string())], [*batch.schema.names, "plan"])

        told = self._kept(missing.select("prompt_norm", "prompt").mapInArrow(work, "prompt_norm string, prompt string, plan string"))
        new = told.select("prompt_norm", F.lit(model).alias("model"), "prompt", "plan", F.lit(cost).alias("cost"), F.current_timestamp().alias("at"))
        if told.limit(1).count():
            self.store.transact(lambda now: [("replace", "plans", new, ["prompt_norm", "model"])])
        both = kept.withColumn("cached", F.lit(True)).unionByName(told.select("prompt_norm", "plan", F.lit(False).alias("cached")))
        return asked.join(both, "prompt_norm").select("prompt", "plan", "cached")

    def forget_plans(self, model: str) -> int:
        return self.store.transact(lambda now: [("delete", "plans", self.spark.createDataFrame([(model,)], "model string"), ["model"])])


def plan_shape(languages: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether a plan has a verdict on its scope and a phrasing in each language."""
    schema = "inScope boolean, queries map<string, string>"

    def usable(plan: Column) -> Column:
        said = F.from_json(plan, schema)
        there = F.lit(True)
        for code in languages:
            there = there & F.try_element_at(said["queries"], F.lit(code)).isNotNull()
        return said["inScope"].isNotNull() & there

    return usable
