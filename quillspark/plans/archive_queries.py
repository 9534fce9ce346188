"""Archive, projects and table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import prompt_norm, tags_of, text_hash
from quillspark.operators import retrieval as R
from quillspark.operators import tables as K
from quillspark.plans.registry import Tables, query

_NORM = r"trim(regexp_replace(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')), '[.!?…]+$', ''))"


@query(f"SELECT conv_id, turn, {_NORM} AS prompt_norm FROM conversations WHERE role = 'user'")
def saved_prompts(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", prompt_norm(F.col("text")).alias("prompt_norm"))


@query(f"""WITH s AS (SELECT conv_id, turn, {_NORM} AS prompt_norm FROM conversations WHERE role = 'user')
SELECT prompt_norm, max(conv_id * 100 + turn) AS newest, count(*) AS saved FROM s GROUP BY prompt_norm""")
def exact_cache(t: Tables) -> DataFrame:
    saved = t.conversations.where("role = 'user'").select(prompt_norm(F.col("text")).alias("prompt_norm"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return saved.groupBy("prompt_norm").agg(F.max("id").alias("newest"), F.count("*").alias("saved"))


#: Cosine from which a saved prompt answers a new one, and how many are looked at.
SAME, LOOKED_AT = 0.95, 5


@query("""WITH k AS (SELECT q.vec_id AS q, e.vec_id AS id, round(1 - round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), 6) AS sim
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND e.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS n FROM k) SELECT q, id, sim FROM r WHERE n <= 5 AND sim >= 0.95""")
def semantic_cache(t: Tables) -> DataFrame:
    """The nearest saved prompts of the same scope (label), of which those similar enough count; scope comes first."""
    saved = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("scope"), F.col("vec_id").alias("self"))
    return cached_answers(saved, saved.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("scope").alias("q_scope"), F.col("self").alias("q_self")))


def cached_answers(saved: DataFrame, asked: DataFrame) -> DataFrame:
    """q, id, sim of the saved prompts (id, v, scope, self) near enough to those asked (q, qv, q_scope, q_self)."""
    near = R.nearest(saved, asked, LOOKED_AT, apart=("self",), alike=("scope",)).select("q", "id", F.round(1 - F.col("d"), 6).alias("sim"))
    return near.where(F.col("sim") >= SAME)


@query("""WITH refs AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE left(sha256(text), 16) END AS hash FROM documents UNION ALL SELECT 1000000 + o_orderkey, 'gone' FROM orders)
SELECT id, hash, (doc_id IS NULL OR left(sha256(text), 16) <> hash) AS lost FROM refs LEFT JOIN documents ON doc_id = id""")
def guarded_hydrate(t: Tables) -> DataFrame:
    """References with the passage they mean, or marked lost where it is gone or its text has changed."""
    refs = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(text_hash(F.col("text"))).alias("hash"))
    refs = refs.unionByName(t.orders.select((F.col("o_orderkey") + 1000000).alias("id"), F.lit("gone").alias("hash")))
    return K.guarded(refs, t.documents.select(F.col("doc_id").alias("id"), "text")).select("id", "hash", "lost")


@query("SELECT user_id, event_type, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY ALL")
def upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "ts").withColumn("_o", F.struct("ts", "event_id"))
    half = F.col("event_id") % 2 == 0
    return K.upsert(rows.where(half), rows.where(~half), ["user_id", "event_type"], "_o").drop("_o")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 100, s_name FROM supplier WHERE s_suppkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(t: Tables) -> DataFrame:
    return K.insert_ignore(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select((F.col("s_suppkey") + 100).alias("id"), F.col("s_name").alias("name")), ["id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return K.delete_where_key(t.lineitem.select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS author,
(p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND p_type <> p_brand)) AS changed FROM part""")
def metadata_sync(t: Tables) -> DataFrame:
    old = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("author"))
    new = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("author"))
    return K.sync(old, new, "id", ["author"])


@query("SELECT user_id, count(*) AS hits, max(event_id) AS last_hit FROM events GROUP BY user_id")
def hit_counter(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("hits"), F.max("event_id").alias("last_hit"))


@query("SELECT p_partkey, lower(p_brand) || ';' || lower(p_type) AS tags FROM part")
def tags_all(t: Tables) -> DataFrame:
    csv = F.concat_ws(", ", F.lower("p_brand"), F.lit(" "), F.lower("p_type"), F.upper("p_brand"))
    return t.part.select("p_partkey", F.array_join(tags_of(csv), ";").alias("tags"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS note FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def additive_schema(t: Tables) -> DataFrame:
    new = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("note"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(new, allowMissingColumns=True)


@query("SELECT c_custkey AS project, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AS member FROM customer")
def membership_flag(t: Tables) -> DataFrame:
    there = t.orders.where(F.col("o_orderpriority").like("1%")).select(F.col("o_custkey").alias("project")).distinct().withColumn("_t", F.lit(True))
    return t.customer.select(F.col("c_custkey").alias("project")).join(there, "project", "left").select("project", F.col("_t").isNotNull().alias("member"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_seen_distinct(t: Tables) -> DataFrame:
    return R.ranked(t.events.select("user_id", "event_type", "event_id"), ["event_id"], ["user_id", "event_type"], 1).drop("rank")


@query("SELECT doc_id AS id, source, text FROM documents ORDER BY doc_id DESC LIMIT 50")
def newest_first(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "source", "text").orderBy(F.desc("id")).limit(50)
