"""Readers' functions on rows: parts put together, key files, links, exports, numerals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import catalog as C
from quillspark.functions import text as X
from quillspark.plans.registry import Tables, query
from quillspark.sources import readers as R


@query("""SELECT l_orderkey AS work, string_agg('part ' || l_linenumber || ' of ' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, 'part ' || l_linenumber || ' of ' || l_partkey) AS text FROM lineitem GROUP BY 1""")
def assembled_works(t: Tables) -> DataFrame:
    """Works put together from their parts in order."""
    text = F.concat(F.lit("part "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_partkey").cast("string"))
    return R.assembled(t.lineitem.select(F.col("l_orderkey").alias("work"), "l_linenumber", text.alias("text")), "work", "l_linenumber")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment || ': ' || c_nationkey END AS segment FROM customer")
def key_files(t: Tables) -> DataFrame:
    """Values of files of `key: value` lines; a value may hold colons, a key may come again, a file may be empty."""
    again = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("\nName:"), F.col("c_mktsegment"))).otherwise("")
    file = F.concat(F.lit("Name: "), F.col("c_name"), F.lit("\r\nno pair\nSegment:  "), F.col("c_mktsegment"), F.lit(": "), F.col("c_nationkey").cast("string"), again)
    file = F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(file)
    pairs = t.customer.select(F.col("c_custkey").alias("id"), R.key_values(file).alias("m"))
    return pairs.select("id", F.col("m")["Name"].alias("name"), F.col("m")["Segment"].alias("segment"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: NOT regexp_matches(h, '^(#|mailto:|javascript:|https?:)')))), ' ') AS links FROM pages""")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(F.sort_array(R.links(F.col("html"))), " ").alias("links"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def exported_works(t: Tables) -> DataFrame:
    """Works that are exported as text: one of their nested exports has that type."""
    kinds = F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "txt").otherwise("xml").alias("type")), F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "txt").otherwise("pdf").alias("type")))
    return R.exported_as(t.orders.select(F.col("o_orderkey").alias("id"), kinds.alias("export")), "txt").select("id")


@query(f"""SELECT p_partkey, p_size, ['IV', 'iix', 'XL', 'MCMXC', 'VV', 'ic', '', 'civil', 'D', 'mm'][p_size % 10 + 1] AS word, word <> '' AND regexp_matches(upper(word), '{C.NUMERAL}') AS numeral FROM part""")
def numerals(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("IV", "iix", "XL", "MCMXC", "VV", "ic", "", "civil", "D", "mm")])
    rows = t.part.select("p_partkey", "p_size", F.get(words, F.col("p_size") % 10).alias("word"))
    return rows.withColumn("numeral", C.is_numeral(F.col("word")))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 100) / 50)), 9) AS score FROM events")
def sigmoid_scores(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(X.sigmoid((F.col("value") - 100) / 50), 9).alias("score"))
