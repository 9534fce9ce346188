"""Catalogue building, rights, exports and projects: parts are works, brands authors, line items parts of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalog as C
from quillspark.operators import retrieval as R
from quillspark.operators import tables as K
from quillspark.plans.registry import Tables, query

#: The year that rights are judged by in these queries.
AS_OF = 2026


@query("""SELECT work, CASE WHEN year IS NULL OR year > 1950 THEN 'none' WHEN year <= 1926 THEN 'age' WHEN regexp_matches(licence, '(?i)steel|brass|eco') THEN 'licence' ELSE 'none' END AS ground
FROM (SELECT p_partkey AS work, CASE WHEN p_size = 10 THEN NULL ELSE 1880 + p_size * 2 END AS year, p_type AS licence FROM part)""")
def rights_grounds(t: Tables) -> DataFrame:
    year = F.when(F.col("p_size") != 10, 1880 + F.col("p_size") * 2)
    return t.part.select(F.col("p_partkey").alias("work"), C.rights_ground(year, F.col("p_type"), AS_OF, "(?i)steel|brass|eco").alias("ground"))


@query("""SELECT work, CASE WHEN died IS NULL THEN 'death unknown' WHEN died + 70 >= 2026 THEN 'protected' WHEN translator IS NOT NULL THEN 'translated' WHEN quality < 75 THEN 'low quality' ELSE '' END AS reason
FROM (SELECT p_partkey AS work, CASE WHEN p_size <> 7 THEN 1900 + p_size * 2 END AS died, CASE WHEN p_size < 9 THEN p_brand END AS translator, CASE WHEN p_size <> 11 THEN p_retailprice / 15 END AS quality FROM part)""")
def rejections(t: Tables) -> DataFrame:
    size = F.col("p_size")
    reason = C.rejection(F.when(size != 7, 1900 + size * 2), F.when(size < 9, F.col("p_brand")), F.when(size != 11, F.col("p_retailprice") / 15), AS_OF)
    return t.part.select(F.col("p_partkey").alias("work"), reason.alias("reason"))


@query("SELECT p_partkey AS work, p_brand AS author, p_name AS title FROM part WHERE contains(lower(p_brand), '#3') OR contains(lower(p_name), 'red')")
def collection_filter(t: Tables) -> DataFrame:
    """An author that matches keeps all their works; else the title must match."""
    hit = F.contains(F.lower("p_brand"), F.lit("#3")) | F.contains(F.lower("p_name"), F.lit("red"))
    return t.part.where(hit).select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("author"), F.col("p_name").alias("title"))


@query("""WITH w AS (SELECT DISTINCT p_partkey AS work, unnest(string_split(lower(p_name), ' ')) AS word FROM part), q AS (SELECT unnest(['widg', 'gadg', 'blue', 'red']) AS prefix)
SELECT DISTINCT work, prefix FROM w JOIN q ON length(prefix) >= 4 AND starts_with(word, prefix)""")
def prefix_mentions(t: Tables) -> DataFrame:
    """Works with a word that begins as a word of the question does, from four letters on; a question has few words."""
    asked = [p for p in ("widg", "gadg", "blue", "red") if len(p) >= 4]
    words = t.part.select(F.col("p_partkey").alias("work"), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    hits = F.array(*[F.when(F.startswith("word", F.lit(p)), p) for p in asked])
    return words.select("work", F.explode(F.array_compact(hits)).alias("prefix")).distinct()


@query(r"SELECT doc_id, list_min(list_transform(regexp_extract_all(text, '(?:^|[^0-9])(1[4-9][0-9][0-9]|20[0-9][0-9])(?:$|[^0-9])', 1), lambda y: y::INTEGER)) AS imprint FROM documents")
def imprint_year(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_min(C.years(F.col("text"))).alias("imprint"))


@query(r"SELECT doc_id, len(string_split(text, '|')) - 1 AS gaps, round(coalesce((len(string_split(text, '|')) - 1) * 1000 / nullif(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0), 0), 6) AS density FROM documents")
def damage_density(t: Tables) -> DataFrame:
    gaps = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return t.documents.select("doc_id", gaps.cast("long").alias("gaps"), F.round(C.per_thousand_words(gaps, F.col("text")), 6).alias("density"))


@query("""WITH u AS (SELECT lang, 1 AS depth, sum(n_chars) AS c FROM documents GROUP BY lang UNION ALL SELECT lang, 2, sum(n_chars) FROM documents GROUP BY lang, source UNION ALL SELECT lang, 3, n_chars FROM documents),
m AS (SELECT lang, depth, avg(c) AS mean FROM u GROUP BY ALL), p AS (SELECT *, bool_and(mean >= 900) OVER (PARTITION BY lang ORDER BY depth) AS ok FROM m)
SELECT lang, coalesce(max(CASE WHEN ok THEN depth END), 0)::BIGINT AS depth FROM p GROUP BY lang""")
def citation_depth(t: Tables) -> DataFrame:
    """The deepest unit of citation whose mean length, as that of all above it, is 900 characters at least.

    One pass: sums of finer units add up to those of coarser ones, and a mean is a total over a number of units.
    """
    fine = t.documents.groupBy("lang", "source").agg(F.sum("n_chars").alias("c"), F.count("*").alias("n"))
    by = fine.groupBy("lang").agg(F.sum("c").alias("c"), F.count("*").alias("n2"), F.sum("n").alias("n3"))
    ok = [F.col("c") / n >= 900 for n in (F.lit(1), F.col("n2"), F.col("n3"))]
    depth = F.when(ok[0] & ok[1] & ok[2], 3).when(ok[0] & ok[1], 2).when(ok[0], 1).otherwise(0)
    return by.select("lang", depth.cast("long").alias("depth"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS place, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY lang")
def facets_present(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame([("en", 0), ("fr", 1), ("de", 2), ("es", 3)], "lang string, place int")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(order), "lang").orderBy("place").select("lang", "place", "n")


def _title() -> Column:
    return F.concat(F.lit("The "), F.col("p_name"), F.lit(", Vol. "), F.col("p_size").cast("string"), F.lit(" (of "), F.col("p_type"), F.lit(")"))


@query("SELECT p_partkey AS work, 'The ' || p_name AS base, p_size AS volume, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM part")
def title_parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("work"), C.base_title(_title()).alias("base"), C.volume_of(_title()).alias("volume"), C.title_key(_title()).alias("title_key"))


@query("SELECT s_suppkey AS id, 'Ann ' || s_name AS shown, -s_nationkey - 50 AS born, s_nationkey + 1 AS died, 'T' || s_suppkey AS translator, s_suppkey % 2 = 0 AS dubious FROM supplier")
def attributions(t: Tables) -> DataFrame:
    role = F.when(F.col("s_suppkey") % 2 == 0, " [Dubious author]").otherwise("")
    nation = F.col("s_nationkey")
    names = F.concat("s_name", F.lit(", A. (Ann), "), (nation + 50).cast("string"), F.lit(" BCE-"), (nation + 1).cast("string"), role, F.lit("; T"), F.col("s_suppkey").cast("string"), F.lit(" [Translator]; X [Illustrator]"))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), C.attribution(names).alias("a"))
    first = F.col("a.authors")[0]
    return rows.select("id", C.display_name(first).alias("shown"), C.lifespan(first)["born"].alias("born"), C.lifespan(first)["died"].alias("died"), "a.translator", "a.dubious")


@query("""SELECT kind, count(*) AS lines, round(sum(l_quantity * 3 * CASE kind WHEN 'cache read' THEN 0.1 WHEN 'cache write' THEN 1.25 ELSE 1 END) / 1e6, 9) AS cost
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'cache read' WHEN 'R' THEN 'cache write' ELSE 'input' END AS kind FROM lineitem) GROUP BY kind""")
def line_costs(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "cache read").when(F.col("l_returnflag") == "R", "cache write").otherwise("input")
    cost = F.sum(C.line_cost(F.col("l_quantity"), F.lit(3.0), F.col("kind")))
    return t.lineitem.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("lines"), F.round(cost, 9).alias("cost"))


@query("""SELECT o_orderkey AS search, CASE WHEN o_custkey < 1000 THEN o_custkey::VARCHAR ELSE (o_custkey // 1000) || '.' || (o_custkey % 1000 // 100) || 'k' END AS tokens,
CASE WHEN o_orderkey * 37 < 60000 THEN (o_orderkey * 37 // 1000) || ' s' ELSE (o_orderkey * 37 // 60000) || ' min ' || (o_orderkey * 37 // 1000 % 60) || ' s' END AS duration FROM orders WHERE o_orderkey > 0""")
def shown_figures(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("search"), C.tokens_shown(F.col("o_custkey")).alias("tokens"), C.duration_shown(F.col("o_orderkey") * 37).alias("duration"))


@query("SELECT l_orderkey AS work, count(*) AS parts, sum(l_quantity)::DOUBLE AS size FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey HAVING count(*) >= 3")
def licensed_parts(t: Tables) -> DataFrame:
    """Works of which enough parts are licensed; the others drop out."""
    return t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("parts"), F.sum("l_quantity").alias("size")).where("parts >= 3")


@query("""WITH p AS (SELECT l_orderkey AS work, count(*) FILTER (WHERE l_tax > 0) AS rated, count(*) FILTER (WHERE l_discount <= 0.05) AS accepted, coalesce(sum(l_quantity) FILTER (WHERE l_discount <= 0.05), 0)::DOUBLE AS size FROM lineitem GROUP BY l_orderkey)
SELECT work, rated, accepted, CASE WHEN accepted = 0 THEN 'no part accepted' WHEN rated * 2 < accepted THEN 'mostly unrated' WHEN size < 50 THEN 'too small' ELSE '' END AS reason FROM p""")
def multi_part_works(t: Tables) -> DataFrame:
    """Works judged by their parts; what is wrong is a reason, never an error."""
    taken = F.col("l_discount") <= 0.05
    by = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.count_if(F.col("l_tax") > 0).alias("rated"), F.count_if(taken).alias("accepted"), F.coalesce(F.sum(F.when(taken, F.col("l_quantity"))), F.lit(0.0)).alias("size"))
    reason = F.when(F.col("accepted") == 0, "no part accepted").when(F.col("rated") * 2 < F.col("accepted"), "mostly unrated").when(F.col("size") < 50, "too small").otherwise("")
    return by.select("work", "rated", "accepted", reason.alias("reason"))


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS list, l_suppkey AS author, l_partkey AS id FROM lineitem), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY list, author ORDER BY id) <= 2)
SELECT id, list, author FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, author) = 1""")
def manifest_claims(t: Tables) -> DataFrame:
    """Works by the first list that claims them; authors' caps come before the claims."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("list"), F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("id")).distinct()
    capped = R.ranked(rows, ["id"], ["list", "author"], 2).drop("rank")
    return R.first_of_key(capped, F.col("id"), ["list", "author"]).select("id", "list", "author")


@query("""SELECT s_suppkey AS author, CASE WHEN n = 0 THEN 'not in the catalogue' ELSE 'everything filtered out' END AS report FROM (SELECT s_suppkey, count(l_suppkey) AS n, count(*) FILTER (WHERE l_quantity >= 50 AND l_discount >= 0.09) AS m
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey) WHERE m = 0""")
def builder_report(t: Tables) -> DataFrame:
    left = t.lineitem.groupBy(F.col("l_suppkey").alias("author")).agg(F.count("*").alias("n"), F.count_if((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.09)).alias("m"))
    rows = t.supplier.select(F.col("s_suppkey").alias("author")).join(left, "author", "left").where("coalesce(m, 0) = 0")
    return rows.select("author", F.when(F.col("n").isNull(), "not in the catalogue").otherwise("everything filtered out").alias("report"))


@query("SELECT o_custkey AS project, o_orderkey AS passage, source AS work, doc_id IS NULL AS lost FROM orders LEFT JOIN documents ON doc_id = o_orderkey")
def project_load(t: Tables) -> DataFrame:
    rows = t.orders.join(t.documents.select("doc_id", "source"), F.col("doc_id") == F.col("o_orderkey"), "left")
    return rows.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("passage"), F.col("source").alias("work"), F.col("doc_id").isNull().alias("lost"))


@query("""WITH x AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS tag, unnest(range(len(string_split(p_name, ' ')))) AS n FROM part)
SELECT lower(tag) AS key, arg_min(tag, id * 1000 + n) AS tag, count(*) AS uses FROM x GROUP BY 1""")
def tag_spellings(t: Tables) -> DataFrame:
    """All tags, each by its first spelling."""
    tags = t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("n", "tag"))
    return tags.groupBy(F.lower("tag").alias("key")).agg(F.min_by("tag", F.struct("p_partkey", "n")).alias("tag"), F.count("*").alias("uses"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part QUALIFY n <= 12)
SELECT p_brand AS author, string_agg('[' || n || '] (' || p_type || ') ' || p_name, chr(10) ORDER BY n) AS prompt FROM r GROUP BY p_brand""")
def candidate_prompt(t: Tables) -> DataFrame:
    """Numbered candidates as lines of a prompt; a list holds twelve at most."""
    rows = K.capped(t.part, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 12)
    line = F.struct("n", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), "p_type", F.lit(") "), "p_name").alias("line"))
    return rows.groupBy(F.col("p_brand").alias("author")).agg(F.array_join(F.sort_array(F.collect_list(line))["line"], "\n").alias("prompt"))


@query("SELECT p_partkey AS work, 'TY  - BOOK' || chr(10) || 'AU  - ' || p_brand || chr(10) || 'TI  - ' || p_name || chr(10) || 'PY  - ' || p_size || chr(10) || 'ER  - ' AS entry FROM part")
def ris_export(t: Tables) -> DataFrame:
    fields = (("TY", F.lit("BOOK")), ("AU", F.col("p_brand")), ("TI", F.col("p_name")), ("PY", F.col("p_size").cast("string")), ("ER", F.lit("")))
    return t.part.select(F.col("p_partkey").alias("work"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}  - "), v) for k, v in fields]).alias("entry"))


@query(r"SELECT item_id, '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '*item ' || item_id || '*' AS quote FROM benchmark")
def markdown_quotes(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n*item "), F.col("item_id").cast("string"), F.lit("*"))
    return t.benchmark.select("item_id", quoted.alias("quote"))


@query("""WITH k AS (SELECT q.vec_id AS q, e.vec_id AS id, round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label = q.label AND e.vec_id % 50 <> 0)
SELECT q, id, d, row_number() OVER (PARTITION BY q ORDER BY d, id) AS position FROM k QUALIFY position <= 8""")
def more_from_work(t: Tables) -> DataFrame:
    """The passages of a shown one's work (label) that aren't shown yet, nearest first, eight at most."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    shown = rows.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"), F.col("label").alias("q_label"))
    near = R.nearest(rows, shown, 8, F.col("id") % 50 != 0, alike=("label",))
    return near.select("q", "id", "d", (F.col("rank") + 1).alias("position"))


@query("""SELECT s_name AS name, CASE WHEN s_nationkey < 5 THEN 'https://one.example/' || s_suppkey || '.txt' WHEN s_nationkey < 10 THEN 'https://two.example/w/' || s_suppkey END AS link FROM supplier""")
def source_links(t: Tables) -> DataFrame:
    source = F.when(F.col("s_nationkey") < 5, "one").when(F.col("s_nationkey") < 10, "two").otherwise("other")
    return t.supplier.select(F.col("s_name").alias("name"), C.source_link(source, F.col("s_suppkey"), {"one": "https://one.example/{}.txt", "two": "https://two.example/w/{}"}).alias("link"))


@query("""SELECT p_type AS genre, count(*) AS works, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type QUALIFY place <= 8""")
def largest_genres(t: Tables) -> DataFrame:
    by = t.part.groupBy(F.col("p_type").alias("genre")).agg(F.count("*").alias("works"))
    return R.top(by, [F.desc("works"), "genre"], 8).select("genre", "works", (F.col("rank") + 1).alias("place"))


@query("""SELECT l_orderkey AS work, l_linenumber AS part, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag THEN '[' || l_returnflag || '] ' ELSE '' END || l_linestatus AS rendered
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)""")
def rendered_segments(t: Tables) -> DataFrame:
    """Segments of works in order, with a citation wherever it changes."""
    before = F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))
    cited = F.when(before.eqNullSafe(F.col("l_returnflag")), "").otherwise(F.concat(F.lit("["), "l_returnflag", F.lit("] ")))
    return t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("part"), F.concat(cited, "l_linestatus").alias("rendered"))
