"""Manifests, minimums and displays: parts are a catalogue's rows, suppliers the authors that are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import catalog as C
from quillspark.operators import archive as A
from quillspark.operators import builder as B
from quillspark.operators import orders as O
from quillspark.plans.cleaning_queries import _plain
from quillspark.plans.registry import Tables, query
from quillspark.plans.source_queries import _BODY, _INNER
from quillspark.sources import catalogs as S

_CATALOG = """catalog AS (SELECT p_partkey AS id, p_brand AS first, CASE WHEN p_size % 9 = 0 THEN '' ELSE left(p_name, 4) END AS other, p_size % 11 = 0 AS dubious,
left(p_name, 6) || CASE WHEN p_size % 5 = 0 THEN ', vol. ' || (1 + p_partkey % 5) ELSE '' END AS title FROM part)"""
_FOUND = f"""{_CATALOG}, wanted AS (SELECT s_nationkey AS grp, s_suppkey AS author_no, CASE s_suppkey % 3 WHEN 0 THEN 'Brand#' || (1 + s_suppkey % 5) WHEN 1 THEN ['red', 'blu', 'col', 'zzz'][1 + s_suppkey % 4] ELSE 'Brand#' || (10 + s_suppkey % 50) END AS key, 4 AS cap FROM supplier WHERE s_suppkey < 60),
found AS (SELECT DISTINCT grp, author_no, key, cap, id, title FROM catalog JOIN wanted ON NOT dubious AND (starts_with(first, key) OR (other <> '' AND starts_with(other, key)))),
base AS (SELECT *, lower(trim(regexp_replace(title, '(?i)[,:;]? *(?:vol(?:ume)?\\.?|part|book) +([0-9]+).*$', ''))) AS b, regexp_matches(title, 'vol\\. [0-9]') AS part FROM found WHERE NOT regexp_matches(title, '^hot')),
whole AS (SELECT *, bool_or(NOT part) OVER (PARTITION BY grp, author_no, b) AS w, row_number() OVER (PARTITION BY grp, author_no, b, part ORDER BY id) AS n FROM base),
one AS (SELECT *, row_number() OVER (PARTITION BY grp, author_no, regexp_replace(trim(regexp_replace(b, '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '') ORDER BY id % 10 <> 0, id) AS again FROM whole WHERE CASE WHEN w THEN NOT part AND n = 1 ELSE n <= 6 END),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, author_no ORDER BY id % 10 <> 0, id) AS place FROM one WHERE again = 1) WHERE place <= cap),
claimed AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY id ORDER BY grp, author_no) = 1),
extras AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 900000 + n_nationkey ELSE n_nationkey * 7 + 1 END AS id, n_name AS key, 'extra' AS title FROM nation),
added AS (SELECT * FROM extras WHERE id NOT IN (SELECT id FROM claimed))"""


def _built(t: Tables) -> tuple[DataFrame, DataFrame]:
    other = F.when(F.col("p_size") % 9 == 0, "").otherwise(F.concat(F.lit("; "), F.left("p_name", F.lit(4))))
    names = F.concat("p_brand", other, F.when(F.col("p_size") % 11 == 0, " [Dubious author]").otherwise(""), F.lit("; Someone [Translator]"))
    title = F.concat(F.left("p_name", F.lit(6)), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(", vol. "), (1 + F.col("p_partkey") % 5).cast("string"))).otherwise(""))
    catalog = t.part.select(F.col("p_partkey").alias("id"), names.alias("authors"), title.alias("title"))
    n = F.col("s_suppkey")
    key = F.when(n % 3 == 0, F.concat(F.lit("Brand#"), (1 + n % 5).cast("string"))).when(n % 3 == 1, F.element_at(F.array(*map(F.lit, ("red", "blu", "col", "zzz"))), (1 + n % 4).cast("int"))).otherwise(F.concat(F.lit("Brand#"), (10 + n % 50).cast("string")))
    wanted = t.supplier.where("s_suppkey < 60").select(F.col("s_nationkey").alias("grp"), n.alias("author_no"), key.alias("key"), F.lit(4).alias("cap"))
    extras = t.nation.select(F.when(F.col("n_nationkey") % 4 == 0, 900000 + F.col("n_nationkey")).otherwise(F.col("n_nationkey") * 7 + 1).cast("long").alias("id"), F.col("n_name").alias("key"), F.lit("extra").alias("title"))
    return B.manifest(catalog, wanted, extras, "^hot", catalog.where("id % 10 = 0"))


@query(f"WITH {_FOUND} SELECT id, key, title, 'catalogue' AS origin FROM claimed UNION ALL SELECT id, key, title, 'extra' FROM added WHERE id IN (SELECT id FROM catalog)")
def built_manifest(t: Tables) -> DataFrame:
    """A catalogue's works by wanted authors: caps first, then the first author's claim, then what is added by hand."""
    return _built(t)[0]


@query(f"""WITH {_FOUND}, c AS (SELECT grp, author_no, count(*) AS had FROM found GROUP BY ALL), k AS (SELECT DISTINCT grp, author_no FROM own)
SELECT key, CASE WHEN had IS NULL THEN 'not in the catalogue' ELSE had || ' works, none left' END AS report FROM wanted LEFT JOIN c USING (grp, author_no) ANTI JOIN k USING (grp, author_no)
UNION ALL SELECT key, 'extra isn''t in the catalogue' FROM added WHERE id NOT IN (SELECT id FROM catalog)""")
def manifest_report(t: Tables) -> DataFrame:
    return _built(t)[1]


@query("""WITH a AS (SELECT DISTINCT conv_id AS question, CASE WHEN conv_id % 3 <> 0 THEN conv_id % 4 END AS min_genres, CASE WHEN conv_id % 2 = 0 THEN 2 END AS min_own FROM conversations),
f AS (SELECT conv_id AS question, role AS genre, CASE WHEN turn % 2 = 0 THEN 'sv' ELSE 'en' END AS lang FROM conversations WHERE turn > 0)
SELECT question, count(DISTINCT genre) AS genres, count(*) FILTER (WHERE lang = 'sv') AS own, count(DISTINCT genre) >= min_genres AS genres_ok, count(*) FILTER (WHERE lang = 'sv') >= min_own AS own_ok FROM a LEFT JOIN f USING (question) GROUP BY question, min_genres, min_own""")
def gold_minimums(t: Tables) -> DataFrame:
    """Minimums of genres and of the home language; a question without answers has none of either."""
    n = F.col("conv_id")
    asked = t.conversations.select(n.alias("question"), F.when(n % 3 != 0, n % 4).alias("min_genres"), F.when(n % 2 == 0, 2).alias("min_own")).distinct()
    found = t.conversations.where("turn > 0").select(n.alias("question"), F.col("role").alias("genre"), F.when(F.col("turn") % 2 == 0, "sv").otherwise("en").alias("lang"))
    return A.gold_minimums(asked, found)


@query(f"""WITH a AS (SELECT page_id AS part, coalesce(nullif({_INNER.format("regexp_extract(html, '<h[1-4][^>]*>(.*?)</h[1-4]>', 1, 'is')")}, ''), {_INNER.format("regexp_extract(html, '<title>(.*?)</title>', 1, 'is')")}) AS title,
{_INNER.format("regexp_extract(html, '<p class=\"information\">(.*?)</p>', 1, 'is')")} AS provenance, {_plain(_BODY)} AS text FROM (SELECT page_id, {{}} AS html FROM pages)),
w AS (SELECT s_suppkey AS id, unnest(range(s_nationkey % 4)) AS n, s_suppkey * 3 + unnest(range(s_nationkey % 4)) AS part FROM supplier),
j AS (SELECT id, n, a.part IS NOT NULL AND regexp_matches(provenance, '(?i)public domain') AS licensed, title, text FROM w LEFT JOIN a USING (part)),
g AS (SELECT id, string_agg(upper(replace(title, 'ß', 'SS')) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n) FILTER (WHERE licensed AND length(text) >= 200) AS text, count(*) FILTER (WHERE NOT licensed) AS skipped FROM j GROUP BY id)
SELECT s_suppkey AS id, text, coalesce(skipped, 0) AS skipped FROM supplier LEFT JOIN g ON id = s_suppkey""".replace("{}", "CASE WHEN page_id % 3 <> 0 THEN replace(html, '<body>', '<body><p class=\"information\">Public domain</p>') ELSE html END"))
def works_of_parts(t: Tables) -> DataFrame:
    """Works put together from the articles of their parts: some aren't licensed, some haven't landed, some are short."""
    html = F.when(F.col("page_id") % 3 != 0, F.replace("html", F.lit("<body>"), F.lit('<body><p class="information">Public domain</p>'))).otherwise(F.col("html"))
    count = (F.col("s_nationkey") % 4).cast("int")
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda n: F.col("s_suppkey") * 3 + n)).otherwise(F.array().cast("array<bigint>"))
    return S.from_parts(t.supplier.select(F.col("s_suppkey").alias("id"), parts.alias("parts")), t.pages.select(F.col("page_id").alias("part"), html.alias("html")), "(?i)public domain")


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 4 END AS shown FROM documents GROUP BY lang")
def languages_in_order(t: Tables) -> DataFrame:
    """Counts in a display order that is given."""
    rows = O.tallied(t.documents, "lang", ["fr", "en", "none"])
    return rows.withColumn("shown", F.when(F.col("lang") == "fr", 1).when(F.col("lang") == "en", 2).otherwise(4))


@query("""WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.00001 WHEN 2 THEN o_totalprice / 1e7 WHEN 3 THEN o_totalprice / 1e6 ELSE o_totalprice END::DOUBLE AS c FROM orders)
SELECT id, CASE WHEN c <= 0 THEN '$0' WHEN c < 0.0001 THEN '<$0.0001' ELSE '$' || format('{:,.4f}', c) END AS usd,
CASE WHEN c <= 0 THEN '0 kr' WHEN c < 0.001 THEN '<0,001 kr' ELSE translate(CASE WHEN c < 0.1 THEN format('{:,.3f}', c) ELSE format('{:,.2f}', c) END, ',.', chr(160) || ',') || ' kr' END AS sek FROM x""")
def costs_shown(t: Tables) -> DataFrame:
    n, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    cost = F.when(n == 0, 0.0).when(n == 1, 0.00001).when(n == 2, price / 1e7).when(n == 3, price / 1e6).otherwise(price)
    return t.orders.select(F.col("o_orderkey").alias("id"), C.usd_shown(cost).alias("usd"), C.sek_shown(cost, "sv").alias("sek"))
