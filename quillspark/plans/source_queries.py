"""Sources and catalogues: lists, trees and pages are made from the tables' names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.cleaning_queries import _entities, _plain
from quillspark.plans.registry import Tables, query
from quillspark.sources import catalogs as S

#: Namespaces of these queries' identifiers, and the folders that hold their texts.
REPOSITORIES = {"greek": "texts-greek", "latin": "texts-latin"}


@query(r"""WITH u AS (SELECT s_suppkey AS id, 'urn:cts:' || CASE WHEN s_nationkey % 3 = 0 THEN 'greek' WHEN s_nationkey % 3 = 1 THEN 'latin' ELSE 'other' END || ':g' || s_suppkey || '.w' || s_nationkey || CASE WHEN s_acctbal > 0 THEN '.ed-la1' ELSE '' END AS urn FROM supplier),
m AS (SELECT id, regexp_extract(urn, '^urn:cts:([A-Za-z]+):([^.\s]+)\.([^.\s]+)\.([^.\s:]+)$', ['s', 'g', 'w', 'e']) AS x FROM u)
SELECT id, 'texts-' || x.s AS repository, 'data/' || x.g || '/' || x.w || '/' || x.g || '.' || x.w || '.' || x.e || '.xml' AS file FROM m WHERE x.e <> '' AND x.s <> 'other'""")
def urn_paths(t: Tables) -> DataFrame:
    space = F.when(F.col("s_nationkey") % 3 == 0, "greek").when(F.col("s_nationkey") % 3 == 1, "latin").otherwise("other")
    urn = F.concat(F.lit("urn:cts:"), space, F.lit(":g"), F.col("s_suppkey").cast("string"), F.lit(".w"), F.col("s_nationkey").cast("string"), F.when(F.col("s_acctbal") > 0, ".ed-la1").otherwise(""))
    return t.supplier.select(F.col("s_suppkey").alias("id"), S.urn_path(urn, REPOSITORIES).alias("p")).where("p is not null").select("id", "p.*")


@query(r"""WITH f AS (SELECT 'g' || s_nationkey AS g, 'w' || s_suppkey AS w, 'ed-' || CASE WHEN s_acctbal > 0 THEN 'lat1' ELSE 'eng2' END AS e, s_suppkey % 5 = 0 AS odd FROM supplier)
SELECT 'urn:cts:latin:' || g || '.' || w || '.' || e AS urn, g AS "group", w AS work FROM f WHERE NOT odd AND regexp_matches(e, '-lat\d*$')""")
def tree_editions(t: Tables) -> DataFrame:
    """Editions in Latin among the paths of a tree; paths whose file isn't named after its folders are none."""
    group, work = F.concat(F.lit("g"), F.col("s_nationkey").cast("string")), F.concat(F.lit("w"), F.col("s_suppkey").cast("string"))
    named = F.when(F.col("s_suppkey") % 5 == 0, F.lit("other")).otherwise(work)
    edition = F.when(F.col("s_acctbal") > 0, "ed-lat1").otherwise("ed-eng2")
    path = F.concat(F.lit("data/"), group, F.lit("/"), work, F.lit("/"), group, F.lit("."), named, F.lit("."), edition, F.lit(".xml"))
    return S.editions(t.supplier.select(path.alias("path")), "latin", "lat")


@query("SELECT s_suppkey AS id, s_name || ' the Elder' AS name FROM supplier")
def cts_names(t: Tables) -> DataFrame:
    xml = F.concat(F.lit('<ti:textgroup><ti:groupname xml:lang="eng">\n '), F.col("s_name"), F.lit("  <i>the\nElder</i></ti:groupname></ti:textgroup>"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), S.cts_field(xml, "groupname").alias("name"))


@query(f"""SELECT p_partkey::VARCHAR AS id, p_brand AS author, {_entities("p_name || ': '|| p_type || ' &amp; more'")} AS title FROM part WHERE p_size > 10""")
def list_entries(t: Tables) -> DataFrame:
    """Entries of list pages; anchors without a colon aren't works."""
    label = F.concat(F.when(F.col("p_size") > 10, F.concat(F.lit("[<b>"), F.col("p_brand"), F.lit("</b>]: "), F.col("p_name"), F.lit(": "))).otherwise(F.lit("no author ")), F.col("p_type"), F.lit(" &amp; more"))
    html = F.concat(F.lit('<li><a href="/x/book/show/'), F.col("p_partkey").cast("string"), F.lit('">'), label, F.lit("</a></li>"))
    rows = t.part.select(F.explode(S.listed(html)).alias("e")).select("e.*")
    return rows.select("id", F.trim(F.translate("author", "[]", "")).alias("author"), "title")


@query(r"""WITH l AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(replace(html, 'href="/', 'href="/wiki/The_Works/'), 'href="/wiki/([^"#]+)"', 1), lambda x: replace(url_decode(x), '_', ' '))) AS links FROM pages)
SELECT page_id, len(links) AS n, array_to_string(list_sort(links), '|') AS links FROM l""")
def wiki_parts(t: Tables) -> DataFrame:
    links = S.sub_pages(F.replace("html", F.lit('href="/'), F.lit('href="/wiki/The_Works/')), F.lit("The Works"))
    return t.pages.select("page_id", F.size(links).cast("long").alias("n"), F.array_join(F.sort_array(links), "|").alias("links"))


@query("""SELECT 'T' || page_id AS title, CASE WHEN page_id % 4 <> 0 THEN greatest(75, 10 + page_id % 90) END::INTEGER AS quality, length(html) AS chars FROM pages WHERE page_id % 7 <> 0""")
def wiki_landed(t: Tables) -> DataFrame:
    """Pages of landed answers; every seventh answer is broken."""
    marks = F.when(F.col("page_id") % 4 != 0, F.array(F.lit("75%"), F.concat((F.col("page_id") % 90 + 10).cast("string"), F.lit("%")))).otherwise(F.array(F.lit("Poems")))
    parse = F.struct(F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title"), F.struct(F.col("html").alias("*")).alias("text"), F.transform(marks, lambda m: F.struct(m.alias("*"))).alias("categories"))
    good = F.to_json(F.struct(parse.alias("parse")))
    return S.wiki_pages(t.pages.select(F.when(F.col("page_id") % 7 == 0, F.lit('{"error": {"code": "x"}}')).otherwise(good).alias("json"))).select("title", "quality", F.length("html").cast("long").alias("chars"))


@query(f"""WITH x AS (SELECT doc_id AS id, text FROM documents WHERE lang = 'en'), y AS (SELECT page_id AS id, {_plain('html')} AS plain FROM pages)
SELECT id, coalesce(x.text, y.plain) AS text, CASE WHEN x.text IS NOT NULL THEN 'text' ELSE 'page' END AS kind FROM x FULL JOIN y USING (id)""")
def landed_texts(t: Tables) -> DataFrame:
    """English documents are the landed texts; the other works have a page alone."""
    return S.landed_texts(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), "text"), t.pages.select(F.col("page_id").alias("id"), "html"))


_INNER = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_BODY = "regexp_replace(regexp_replace(html, '^.*?</head>', '', 'is'), '<p class=\"(title|information|footer|skip|updat)\".*?</p>|<h[1-4][^>]*>.*?</h[1-4]>', '', 'gis')"


@query(f"""SELECT page_id, coalesce(nullif({_INNER.format("regexp_extract(html, '<h[1-4][^>]*>(.*?)</h[1-4]>', 1, 'is')")}, ''), {_INNER.format("regexp_extract(html, '<title>(.*?)</title>', 1, 'is')")}) AS title,
{_INNER.format("regexp_extract(html, '<p class=\"information\">(.*?)</p>', 1, 'is')")} AS provenance, {_plain(_BODY)} AS text FROM pages""")
def articles(t: Tables) -> DataFrame:
    found = S.article(F.col("html"), "(?i)public domain|creative commons")
    return t.pages.select("page_id", *[found[c].alias(c) for c in ("title", "provenance", "text")])


@query(r"""SELECT p_partkey AS id, CASE WHEN NOT contains(lower(p_name), 'widget') THEN 'title' WHEN NOT contains(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), 'brand 1') THEN 'author' ELSE '' END AS fault FROM part""")
def edition_faults(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), S.edition_fault(F.col("p_name"), F.col("p_brand"), F.lit("Widget"), F.lit("BRAND-1")).alias("fault"))


@query(r"""SELECT doc_id AS id, CASE WHEN n_chars * 20 < 12000 THEN 'characters' WHEN n_chars // 50 < 10 THEN 'chunks' WHEN len(regexp_extract_all(text, '[^ \t\r\n]+')) * 8 < 2500 THEN 'words' ELSE '' END AS floor FROM documents""")
def size_floors(t: Tables) -> DataFrame:
    """The first floor that a work of these sizes misses."""
    words = F.regexp_count("text", F.lit(r"[^ \t\r\n]+")) * 8
    sizes = {"characters": F.col("n_chars") * 20, "chunks": F.floor(F.col("n_chars") / 50), "words": words}
    return t.documents.select(F.col("doc_id").alias("id"), S.too_small(sizes).alias("floor"))


@query("""SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1) AND (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) OR NOT regexp_matches(p_name, '(?i)^(red|cold) '))""")
def admitted_works(t: Tables) -> DataFrame:
    ids = lambda n: t.lineitem.where(F.col("l_quantity") == n).select(F.col("l_partkey").alias("id"))
    return S.admitted(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "(?i)^(red|cold) ", ids(50), ids(1))
