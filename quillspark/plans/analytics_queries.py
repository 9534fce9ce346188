"""Corpus, usage and cost analytics; catalogue operators on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import period_of
from quillspark.operators import retrieval as R
from quillspark.operators import tables as K
from quillspark.plans.registry import Tables, query
from quillspark.plans.retrieval_queries import _AUTHOR, author_of


@query(f"SELECT count(*) AS passages, count(DISTINCT source) AS works, count(DISTINCT {_AUTHOR}) AS authors, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents")
def corpus_counts(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("passages"), F.countDistinct("source").alias("works"), F.countDistinct(author_of(F.col("source"))).alias("authors"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, source, count(*) AS n, grouping(lang) AS all_langs, grouping(source) AS all_sources FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def collection_stats(t: Tables) -> DataFrame:
    sets = t.documents.groupingSets([["lang"], ["source"]], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.grouping("lang").cast("long").alias("all_langs"), F.grouping("source").cast("long").alias("all_sources"))


@query("SELECT round(coalesce(sum(CASE WHEN lang IN ('fr', 'de') THEN n_chars END)::DOUBLE / nullif(sum(n_chars), 0), 0), 9) AS share FROM documents")
def selection_share(t: Tables) -> DataFrame:
    part = F.sum(F.when(F.col("lang").isin("fr", "de"), F.col("n_chars")))
    return t.documents.agg(F.round(F.coalesce(part / F.nullif(F.sum("n_chars"), F.lit(0)), F.lit(0.0)), 9).alias("share"))


@query("SELECT count(*) AS searches, round(coalesce(sum(value), 0), 4) AS cost, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type LIKE 'p%') AS remote, round(sum(value * CAST(props->>'k' AS INTEGER)), 2) AS weighted FROM events")
def usage_stats(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return t.events.agg(F.count("*").alias("searches"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("cost"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type").like("p%")).alias("remote"), F.round(F.sum(F.col("value") * k), 2).alias("weighted"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS cost, round(100 * sum(value) / sum(sum(value)) OVER (), 4) AS percent FROM events GROUP BY event_type")
def percent_share(t: Tables) -> DataFrame:
    by = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("c"))
    return by.select("event_type", "n", F.round("c", 4).alias("cost"), F.round(100 * F.col("c") / F.sum("c").over(Window.partitionBy()), 4).alias("percent"))


@query("""SELECT l_returnflag AS step, l_linestatus AS label, count(*) AS lines, sum(l_quantity)::DOUBLE AS tokens, round(sum(l_quantity * l_discount) / 1e6, 9) AS cost
FROM lineitem GROUP BY ALL""")
def cost_breakdown(t: Tables) -> DataFrame:
    """Costs by step and label from stored JSON, which is parsed and exploded; what can't be read counts as empty."""
    line = F.struct(F.col("l_linestatus").alias("label"), F.col("l_quantity").alias("tokens"), F.col("l_discount").alias("perMillion"))
    stored = t.lineitem.select(F.col("l_returnflag").alias("step"), F.to_json(F.array(line)).alias("detail"))
    parsed = stored.select("step", F.explode(F.coalesce(F.from_json("detail", "array<struct<label:string,tokens:double,perMillion:double>>"), F.array())).alias("l"))
    return parsed.groupBy("step", "l.label").agg(F.count("*").alias("lines"), F.sum("l.tokens").alias("tokens"), F.round(F.sum(F.col("l.tokens") * F.col("l.perMillion")) / 1e6, 9).alias("cost"))


@query("SELECT o_custkey AS project, count(*) AS passages, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def project_counts(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("passages"), F.round(F.sum("o_totalprice"), 2).alias("cost"))
    return t.customer.select(F.col("c_custkey").alias("project")).join(by, "project", "left").select("project", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("SELECT p_brand AS author, p_type AS genre, count(*) AS works, min(p_name) AS first_title FROM part GROUP BY ALL")
def collection_sections(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("author"), F.col("p_type").alias("genre")).agg(F.count("*").alias("works"), F.min("p_name").alias("first_title"))


@query("SELECT o_orderkey AS search, greatest(0, (SELECT count(*) FROM part) - o_custkey) AS growth FROM orders")
def corpus_growth(t: Tables) -> DataFrame:
    now = F.lit(t.part.count())  # one number
    return t.orders.select(F.col("o_orderkey").alias("search"), F.greatest(F.lit(0), now - F.col("o_custkey")).alias("growth"))


@query("""SELECT p_partkey AS work, CASE WHEN p_size * 45 - 60 < 500 THEN 'antiquity' WHEN p_size * 45 - 60 < 1450 THEN 'medieval' WHEN p_size * 45 - 60 < 1650 THEN 'renaissance'
WHEN p_size * 45 - 60 < 1800 THEN 'enlightenment' WHEN p_size * 45 - 60 < 1900 THEN 'nineteenth' ELSE 'modern' END AS period FROM part""")
def period_of_year(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("work"), period_of(F.col("p_size") * 45 - 60).alias("period"))


@query("SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part QUALIFY n <= 12")
def cap_per_author(t: Tables) -> DataFrame:
    return K.capped(t.part, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 12).select("p_brand", "p_partkey", "p_name", "n")


@query("SELECT lower(p_name) AS title_key, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best FROM part GROUP BY 1")
def best_per_title(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_name").alias("title_key")).agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"))


@query("""SELECT p_type AS series, p_partkey AS work FROM (SELECT *, max((p_size = 50)::INT) OVER (PARTITION BY p_type) AS has_whole,
row_number() OVER (PARTITION BY p_type, p_size = 50 ORDER BY p_partkey) AS n FROM part) WHERE (has_whole = 1 AND p_size = 50 AND n = 1) OR (has_whole = 0 AND n <= 6)""")
def series_collapse(t: Tables) -> DataFrame:
    """A whole edition (here size 50) stands for its series; a series without one keeps its first six parts."""
    whole = t.part.where("p_size = 50").groupBy(F.col("p_type").alias("series")).agg(F.min("p_partkey").alias("work"))
    parts = t.part.select(F.col("p_type").alias("series"), F.col("p_partkey").alias("work")).join(whole.select("series"), "series", "left_anti")
    return whole.unionByName(R.ranked(parts, ["work"], ["series"], 6).drop("rank"))


@query("SELECT n_name, count(s_suppkey) AS indexed, count(s_suppkey) FILTER (WHERE s_acctbal > 0) AS complete FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def ingest_status(t: Tables) -> DataFrame:
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("s_suppkey").alias("indexed"), F.count_if(F.col("s_acctbal") > 0).alias("complete"))


@query("SELECT p_brand FROM part WHERE p_size > 40 INTERSECT SELECT p_brand FROM part WHERE p_size < 5")
def author_overlap(t: Tables) -> DataFrame:
    return t.part.where("p_size > 40").select("p_brand").intersect(t.part.where("p_size < 5").select("p_brand"))


@query("SELECT text, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_guard(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def missing_report(t: Tables) -> DataFrame:
    there = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return t.supplier.select(F.col("s_nationkey").alias("nation")).distinct().join(there, "nation", "left_anti")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def usage_by_hour(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"))
