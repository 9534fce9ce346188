"""Structure of works: documents are works, each of their lines a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import headings as H
from quillspark.operators import structure as S
from quillspark.plans.registry import Tables, query


def works(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("work_id"), F.coalesce("lang", F.lit("en")).alias("lang"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _mentions(words: dict[str, str], pattern: str = r"\b({})\b") -> str:
    own = " ".join(f"WHEN '{code}' THEN regexp_matches(line, '(?i){pattern.format(w)}')" for code, w in words.items() if code != "en")
    return f"CASE lang {own} ELSE regexp_matches(line, '(?i){pattern.format(words['en'])}') END"


_PARTS = r"""
w AS (SELECT doc_id AS work_id, coalesce(lang, 'en') AS lang, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT work_id, lang, unnest(string_split_regex(text, '\n\s*\n')) AS part, unnest(list_concat(regexp_extract_all(text, '\n\s*\n'), [''])) AS gap, unnest(range(len(string_split_regex(text, '\n\s*\n')))) AS n FROM w),
placed AS (SELECT *, coalesce(sum(length(part) + length(gap)) OVER (PARTITION BY work_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts),
trimmed AS (SELECT work_id, lang, n, (pos + length(part) - length(regexp_replace(part, '^\s+', '')))::BIGINT AS start, regexp_replace(part, '^\s+|\s+$', '', 'g') AS text FROM placed),
paras AS (SELECT work_id, lang, row_number() OVER (PARTITION BY work_id ORDER BY n) - 1 AS i, start, start + length(text) AS "end", text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM trimmed WHERE text <> '')"""
_NAME = rf"""CASE WHEN clean = upper(clean) THEN array_to_string(list_transform(regexp_extract_all(lower(clean), '\p{{L}}+|[^\p{{L}}]+'),
 lambda t: CASE WHEN t <> '' AND regexp_matches(t, '{H.ROMAN}') THEN upper(t) ELSE upper(t[1]) || t[2:] END), '') ELSE clean END"""
_MARKED = rf"""{_PARTS},
looked AS (SELECT *, line = upper(line) AND regexp_matches(line, '[A-ZÅÄÖ]') AS capitals, len(string_split(line, ' ')) AS words, {_mentions(H.BODY)} AS b, {_mentions(H.APPARATUS)} AS a, {_mentions(H.KEYWORDS)} AS k,
 {_mentions(H.KEYWORDS, "^({})\\b")} AS opens FROM paras),
cand AS (SELECT *, len(string_split(text, chr(10))) <= 3 AND length(line) <= 90 AND NOT regexp_matches(line, '[?!]$') AND ((capitals AND ((words = 1 AND length(line) < 24) OR words <= 8)) OR opens OR (capitals AND k)) AS c FROM looked),
run AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY i) AS r FROM cand),
head AS (SELECT *, c AND count(*) FILTER (WHERE c) OVER (PARTITION BY work_id, r) < 3 AS heading, regexp_replace(regexp_replace(trim(text), '[.:;,\s]+$', ''), '\s+', ' ', 'g') AS clean FROM run),
span AS (SELECT *, min(CASE WHEN heading AND b AND NOT a THEN i END) OVER w AS first, max(CASE WHEN heading AND b AND NOT a THEN i END) OVER w AS last, max(CASE WHEN heading AND NOT a THEN i END) OVER w AS own,
 count(*) FILTER (WHERE heading) OVER w AS n, last_value(CASE WHEN heading THEN {_NAME} END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i) AS locator,
 last_value(CASE WHEN heading THEN a END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY i) AS under FROM head WINDOW w AS (PARTITION BY work_id))"""


@query(f'WITH {_PARTS} SELECT work_id, i, start, "end", length(text)::BIGINT AS chars FROM paras')
def paragraph_spans(t: Tables) -> DataFrame:
    """Paragraphs of each work with the offsets that cut them out of its text."""
    return S.paragraphs(works(t)).select("work_id", "i", "start", "end", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {_MARKED} SELECT work_id, i, heading, locator, n >= 3 AND CASE WHEN first IS NULL THEN coalesce(under, false) AND coalesce(i < own, false)
 ELSE i < first OR (i > last AND (locator IS NULL OR coalesce(under, false))) END AS front FROM span""")
def marked_paragraphs(t: Tables) -> DataFrame:
    """Real headings by the rules of each language, the reference of each paragraph, and front matter."""
    return S.marked(works(t)).select("work_id", "i", "heading", "locator", "front")


@query()
def chunk_documents(t: Tables) -> DataFrame:
    """Chunks of whole documents by their structure: the packing is a fold that SQL can't express; its tests compare it with
    a plain version, paragraph by paragraph."""
    return S.chunks(works(t))


@query(f"WITH {_MARKED} SELECT work_id, i, true AS covered, true AS in_order, true AS within_bounds FROM span WHERE NOT heading AND length(text) BETWEEN {S.LEAST + 1} AND {S.HARD} QUALIFY count(*) OVER (PARTITION BY work_id, text) = 1")
def chunk_properties(t: Tables) -> DataFrame:
    """Of each paragraph that a chunk can hold whole and that a work has once (a chunk equal to the one before is left out),
    whether one does; of its work, whether chunks are in order and no longer
    than they may be, and cut out of the text what they say. The SQL finds the paragraphs and expects no fault."""
    own = works(t)
    at = S.chunks(own.withColumn("whole", F.col("text"))).select("work_id", "ordinal", "char_start", "char_end", "text", "whole")
    said = F.substring("whole", F.col("char_start").cast("int") + 1, F.length(F.split_part("text", F.lit("\n\n"), F.lit(1)))) == F.split_part("text", F.lit("\n\n"), F.lit(1))
    fits = (F.length("text") > S.LEAST) & (F.length(F.replace("text", F.lit("\n\n"), F.lit(""))) <= S.HARD) & said
    by = at.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "char_start", "char_end"))).alias("c"), F.every(fits).alias("within_bounds"))
    by = by.withColumn("in_order", F.forall(F.transform("c", lambda x, i: (x["ordinal"] == i) & ((i == 0) | (x["char_end"] > F.get("c", i - 1)["char_end"]))), lambda x: x))
    paras = S.marked(own).where(~F.col("heading") & F.length("text").between(S.LEAST + 1, S.HARD))
    # Paragraphs are told apart by SHA-256, so that no text moves; one shuffle by work serves the window and the join.
    paras = paras.select("work_id", "i", "start", "end", F.unhex(F.sha2("text", 256)).alias("_text")).repartition("work_id")
    paras = paras.withColumn("_n", F.count("*").over(Window.partitionBy("work_id", "_text"))).where("_n = 1").select("work_id", "i", "start", "end")
    rows = paras.join(by, "work_id", "left")
    return rows.select("work_id", "i", F.coalesce(F.exists("c", lambda x: (x["char_start"] <= F.col("start")) & (x["char_end"] >= F.col("end"))), F.lit(False)).alias("covered"), "in_order", "within_bounds")


@query("""SELECT p_partkey, regexp_replace(replace(p_name, '_', ''), '^[ \\t]*(chap(ter)?|book|sect(ion)?|part)\\b\\.?[ \\t]*[ivxlcdm0-9]*\\.?[ \\t]*', '', 'i') AS own,
len(list_filter(regexp_split_to_array(p_name, '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND NOT regexp_matches(w, '(?i)^(the|a|an|and|of|book|chapter|part|section|letter|poem|oration|speech|volume|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|[ivxlcdm]+|[0-9]+)$'))) > 0 AS adds,
CASE WHEN len(string_split(p_type, ' ')) <= 2 THEN p_type ELSE array_to_string(string_split(p_type, ' ')[1:2], ' ') || '…' END AS short, upper(replace(p_brand, '#', ' ')) || ' ' || p_size AS label FROM part""")
def heading_parts(t: Tables) -> DataFrame:
    """Unit labels, and what a heading adds to them."""
    return t.part.select(
        "p_partkey", H.own_part(F.col("p_name")).alias("own"), H.adds_something(F.col("p_name")).alias("adds"), H.first_words(F.col("p_type"), 2).alias("short"),
        H.unit_label(F.replace("p_brand", F.lit("#"), F.lit("_")), F.col("p_size").cast("string")).alias("label"),
    )
