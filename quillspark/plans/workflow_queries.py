"""Searches, projects and evaluations: orders are searches, customers projects, parts works, conversations questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import archive as A
from quillspark.plans.archive_queries import _NORM
from quillspark.plans.registry import Tables, query
from quillspark.sources.tei import tei_segments


@query(f"""WITH s AS (SELECT conv_id * 1000 + turn AS search, {_NORM} AS p, 'm' || (conv_id % 2) AS model, conv_id AS saved FROM conversations WHERE role = 'user'),
newest AS (SELECT p, model, arg_max(search, (saved, search)) AS search FROM s GROUP BY ALL), asked AS (SELECT conv_id * 1000 + turn AS ask, {_NORM} AS p, 'm' || (turn % 2) AS model FROM conversations)
SELECT ask, search FROM asked LEFT JOIN newest USING (p, model)""")
def exact_cache_hits(t: Tables) -> DataFrame:
    """Answers kept for a question, its filter and the model."""
    scope = A.scope_of({"genre": F.array(F.lit("verse"), F.lit("drama")), "era": F.array().cast("array<string>")})
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("search"), F.col("text").alias("prompt"), scope.alias("scope"), "role", "conv_id", "turn")
    saved = rows.where("role = 'user'").select("search", "prompt", "scope", F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"), F.col("conv_id").alias("at"))
    return A.exact_hits(saved, rows.select(F.col("search").alias("ask"), "prompt", "scope", F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model")))


@query("""WITH titled AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN left(p_name, 5) || ' ' || (1 + p_size % 4) WHEN 1 THEN '!?' ELSE left(p_name, 5) END AS title FROM part),
s AS (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM titled), n AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM s),
taken AS (SELECT DISTINCT trim(regexp_replace(lower(left(p_name, 5)), '[^a-z0-9]+', '-', 'g'), '-') || (CASE WHEN p_size % 2 = 0 THEN '' ELSE '-3' END) AS name FROM part WHERE p_size IN (3, 4)),
names AS (SELECT name FROM taken UNION SELECT s FROM s), free AS (SELECT s, m, row_number() OVER (PARTITION BY s ORDER BY m) AS k FROM (SELECT DISTINCT s FROM s), range(2, 3000) t(m) WHERE s || '-' || m NOT IN (SELECT name FROM names)),
ranked AS (SELECT id, n.s, n - (n.s NOT IN (SELECT name FROM taken))::INT AS k FROM n)
SELECT id, CASE WHEN r.k = 0 THEN r.s ELSE r.s || '-' || m END AS slug FROM ranked r LEFT JOIN free f ON f.s = r.s AND f.k = r.k""")
def unique_slugs(t: Tables) -> DataFrame:
    """Titles that come again, that are empty, and that look like another one with a number."""
    word = F.left("p_name", F.lit(5))
    title = F.when(F.col("p_size") % 7 == 0, F.concat(word, F.lit(" "), (1 + F.col("p_size") % 4).cast("string"))).when(F.col("p_size") % 7 == 1, "!?").otherwise(word)
    taken = t.part.where(F.col("p_size").isin(3, 4)).select(F.concat(X.slug(word), F.when(F.col("p_size") % 2 == 0, "").otherwise("-3")).alias("slug")).distinct()
    return A.with_unique_slugs(t.part.select(F.col("p_partkey").alias("id"), title.alias("title")), taken, "title", "id").select("id", "slug")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS project, l_partkey AS passage FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey AS project, l_partkey AS passage FROM lineitem WHERE l_quantity < 10)
(FROM m EXCEPT FROM a) UNION ALL (FROM a EXCEPT FROM m)""")
def toggled_members(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_orderkey").alias("project"), F.col("l_partkey").alias("passage"), "l_returnflag", "l_quantity")
    members = pairs.where("l_returnflag = 'R'").select("project", "passage").distinct()
    return A.toggled(members, pairs.where("l_quantity < 10"), ["project", "passage"])


@query("SELECT c_custkey AS project, left(trim('  ' || repeat(c_name, 9) || ' '), 120) AS name, nullif(left(trim(c_mktsegment), 500), 'BUILDING') AS note FROM customer")
def tidy_projects(t: Tables) -> DataFrame:
    found = A.tidy_project(F.concat(F.lit("  "), F.repeat("c_name", F.lit(9)), F.lit(" ")), F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")))
    return t.customer.select(F.col("c_custkey").alias("project"), *[c.alias(n) for n, c in found.items()])


@query("SELECT p_partkey AS work, count(l_orderkey) AS chunk_count, count(l_orderkey) > 0 AS complete FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity < 5) ON l_partkey = p_partkey GROUP BY 1")
def published_works(t: Tables) -> DataFrame:
    return A.published(t.part.select(F.col("p_partkey").alias("work")), t.lineitem.where("l_quantity < 5").select(F.col("l_partkey").alias("work")))


@query("""WITH now AS (SELECT doc_id AS id, left(sha256(text), 16) AS h FROM documents WHERE lang <> 'fr'), was AS (SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'old' ELSE left(sha256(text), 16) END AS h FROM documents WHERE lang <> 'en')
SELECT id, CASE WHEN was.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'gone' ELSE 'changed' END AS change FROM now FULL JOIN was USING (id) WHERE now.h IS DISTINCT FROM was.h""")
def vector_changes(t: Tables) -> DataFrame:
    from quillspark.functions.text import text_hash

    was = t.documents.where("lang <> 'en'").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "old").otherwise(text_hash(F.col("text"))).alias("hash"))
    return A.vector_changes(t.documents.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), "text"), was)


@query("""SELECT l_orderkey AS search, '# Search ' || l_orderkey || chr(10) || chr(10) || string_agg('> ' || p_name || chr(10) || '> ' || p_type || chr(10) || chr(10) || '— ' || p_brand || ', *' || p_name || '*, ' || l_linenumber, chr(10) || chr(10) ORDER BY l_linenumber, p_partkey) || chr(10) AS document
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def markdown_documents(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.markdown_documents(rows.select(
        F.col("l_orderkey").alias("search"), F.concat(F.lit("Search "), F.col("l_orderkey").cast("string")).alias("question"), F.struct("l_linenumber", "p_partkey").alias("n"), F.col("p_brand").alias("author"),
        F.col("p_name").alias("title"), F.col("l_linenumber").cast("string").alias("locator"), F.concat("p_name", F.lit("\n"), "p_type").alias("text"),
    ))


@query("""WITH w AS (SELECT p_type AS section, p_brand AS author, string_agg((1800 + p_size) || ' ' || p_name, '; ' ORDER BY p_size, p_name) AS works FROM part GROUP BY ALL)
SELECT section, string_agg(author || ': ' || works, ' | ' ORDER BY author) AS listed FROM w GROUP BY section""")
def nested_sections(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("author"), (1800 + F.col("p_size")).alias("year"), F.col("p_name").alias("title"), F.col("p_type").alias("genre"))
    shown = lambda a: F.concat(a["author"], F.lit(": "), F.array_join(F.transform(a["works"], lambda w: F.concat(w["year"].cast("string"), F.lit(" "), w["title"])), "; "))
    return A.sections(rows, F.col("genre")).select("section", F.array_join(F.transform("authors", shown), " | ").alias("listed"))


@query("""SELECT p_partkey AS work, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS by_year, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS by_title FROM part""")
def orders_of_works(t: Tables) -> DataFrame:
    """Places of an author's works by year and by title, titles as readers look them up: case and accents don't count."""
    own = Window.partitionBy("p_brand")
    return t.part.select(
        F.col("p_partkey").alias("work"), F.row_number().over(own.orderBy("p_size", "p_partkey")).alias("by_year"), F.row_number().over(own.orderBy(F.collate("p_name", "UNICODE_CI_AI"), "p_partkey")).alias("by_title")
    )


@query("""WITH wanted AS (SELECT DISTINCT l_orderkey AS question, l_suppkey AS author FROM lineitem WHERE l_returnflag = 'N'), found AS (SELECT DISTINCT l_orderkey AS question, l_suppkey AS author FROM lineitem WHERE l_quantity > 20),
v AS (SELECT question, author, CASE WHEN author NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'not indexed' WHEN f.author IS NOT NULL THEN 'hit' ELSE 'miss' END AS verdict FROM wanted LEFT JOIN found f USING (question, author))
SELECT question, count(*) FILTER (WHERE verdict <> 'not indexed') AS testable, count(*) FILTER (WHERE verdict = 'hit') AS hits, round(count(*) FILTER (WHERE verdict = 'hit') / nullif(count(*) FILTER (WHERE verdict <> 'not indexed'), 0), 6) AS recall FROM v GROUP BY question""")
def gold_recall_by_question(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("question"), F.col("l_suppkey").alias("author"), "l_returnflag", "l_quantity")
    wanted = rows.where("l_returnflag = 'N'").select("question", "author").distinct()
    return A.recall(A.gold_verdicts(wanted, rows.where("l_quantity > 20"), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("author"))))


@query("""SELECT l_orderkey AS search, round(avg(l_discount), 6) AS judged, sum(l_quantity * l_linenumber)::DOUBLE AS cost FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n <= 12 GROUP BY 1""")
def judged_searches(t: Tables) -> DataFrame:
    """Mean score of a search's first twelve passages, and the cost of its nested steps."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    steps = t.lineitem.withColumn("n", n).where("n <= 12").groupBy(F.col("l_orderkey").alias("search")).agg(F.avg("l_discount").alias("j"), F.collect_list(F.struct((F.col("l_quantity") * F.col("l_linenumber")).alias("cost"))).alias("steps"))
    return steps.select("search", F.round("j", 6).alias("judged"), F.aggregate("steps", F.lit(0.0), lambda s, x: s + x["cost"]).alias("cost"))


@query("""WITH u AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE json_extract_string(props, '$.k')::INTEGER END AS k, 'event' AS kind FROM events UNION ALL SELECT o_orderkey, o_custkey % 10, 'order' FROM orders)
SELECT kind, count(*) AS n, sum(k)::BIGINT AS tokens FROM u GROUP BY kind""")
def cost_union(t: Tables) -> DataFrame:
    """Costs of two tables together; stored JSON that is broken counts as nothing."""
    stored = t.events.select(F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")).alias("json"), F.lit("event").alias("kind"))
    orders = t.orders.select(F.to_json(F.struct((F.col("o_custkey") % 10).alias("k"))).alias("json"), F.lit("order").alias("kind"))
    return stored.unionByName(orders).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.from_json("json", "k int")["k"], F.lit(0))).alias("tokens"))


@query("""SELECT s_nationkey AS work_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, 'BOOK 1, CHAPTER ' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS path, s_name AS head, 'Of _' || s_name || '_ & more' AS text FROM supplier""")
def tei_segments_of_suppliers(t: Tables) -> DataFrame:
    """Segments of TEI documents with a book for each nation and a chapter without number for each of its suppliers."""
    chapter = F.concat(
        F.lit('<div2 type="chapter"><head>'), "s_name", F.lit("</head><p>Of <hi>"), "s_name", F.lit("</hi><note>not <p>this</p></note>\n  &amp; more</p></div2>")
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", chapter.alias("c")))), lambda x: x["c"]), "")
    xml = F.concat(F.lit('<TEI><teiHeader><p>no</p></teiHeader><text><body><div1 type="book" n="1">'), body, F.lit("</div1></body></text></TEI>"))
    return tei_segments(t.supplier.groupBy(F.col("s_nationkey").alias("work_id")).agg(xml.alias("xml")))
