"""Folders that change: index segments, records, vectors, landings and editions, brought from the tables to their last state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators.records import Records
from quillspark.operators.vectors import Vectors
from quillspark.plans.registry import Tables, query
from quillspark.plans.retrieval_queries import _STEMS
from quillspark.sources import dialects as D
from quillspark.sources import landing as L
from quillspark.sources.versioned import shared_folder
from quillspark.streaming.ingest import hashed_words


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4()}"


#: A request as people type it: capitals, an apostrophe, marks of query languages, accents, inflected forms and a repeated one.
ASKED = ["The", "DE'LA", '"l\'en" (was)', "Ères", "walking", "walked", "for-the"]
#: The terms and phrases that the request comes down to, and how often each counts.
PHRASES = I.phrases(ASKED)


def _scored(corpus: str, phrases: dict) -> str:
    """DuckDB SQL: id and score of the texts of a corpus (id, text) for phrases of one or two terms, by their places."""
    wanted = ", ".join(f"({n}, '{p[0]}', {repr(p[1]) if len(p) > 1 else 'NULL'}, {phrases[p]})" for n, p in enumerate(sorted(phrases)))
    return rf"""{_STEMS.replace("FROM documents UNION", f"FROM {corpus} UNION")},
tok AS (SELECT id, n, term FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')) AS raw, unnest(range(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')))) AS n FROM {corpus}) JOIN stems USING (raw)),
stats AS (SELECT id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')) AS dl FROM {corpus}), total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
asked(p, a, b, times) AS (VALUES {wanted}),
hits AS (SELECT p, times, tok.id, count(*) AS tf FROM asked JOIN tok ON tok.term = a LEFT JOIN tok AS nxt ON b IS NOT NULL AND nxt.id = tok.id AND nxt.n = tok.n + 1 AND nxt.term = b WHERE b IS NULL OR nxt.id IS NOT NULL GROUP BY ALL),
dfs AS (SELECT p, count(*) AS df FROM hits GROUP BY p)
SELECT id, round(sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM hits JOIN dfs USING (p) JOIN stats USING (id), total GROUP BY id"""


@query(f"WITH {_scored('(SELECT doc_id AS id, text FROM documents)', PHRASES)}")
def typed_search(t: Tables) -> DataFrame:
    """Scores of a request as it is typed, by the phrases that its spellings come down to."""
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("work"), "text")
    return I.bm25(I.index_for(t.spark, texts), PHRASES).select("id", "score")


_LAST = "(SELECT doc_id AS id, CASE WHEN source IN ('src1', 'src2') THEN upper(text) ELSE text END AS text FROM documents WHERE source IS NULL OR source NOT IN ('src3', 'src4') OR (source = 'src4' AND doc_id % 2 = 0))"


@query(f"WITH last AS {_LAST}, {_scored('last', I.phrases(['The', 'LA']))}")
def segmented_search(t: Tables) -> DataFrame:
    """The same scores after works have landed in batches, one of them twice, and gone, as after a full rebuild."""
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("work"), "text")
    index = I.Index(t.spark, folder(t, "segments"))
    first = F.coalesce(F.col("work").isin("src1", "src2", "src3", "src4"), F.lit(False))
    index.add(rows.where(first), "s", 0)
    index.add(rows.where(~first), "s", 1)
    index.add(rows.where(~first), "s", 1)  # a batch that runs again
    index.add(rows.where(F.col("work").isin("src1", "src2")).withColumn("text", F.upper("text")), "s", 2)
    index.remove(t.spark.createDataFrame([("src3",)], "work string"))
    index.merge()
    index.add(rows.where("work = 'src4' AND id % 2 = 0"), "s", 3)
    return I.bm25(index.view(), I.phrases(["The", "LA"])).select("id", "score")


@query("""WITH p AS (SELECT c_custkey AS project, trim(left(trim(' ' || c_name), 120)) AS title FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0),
a AS (SELECT DISTINCT o_custkey AS project, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), m AS (SELECT project, id FROM a JOIN documents ON doc_id = id WHERE text IS NOT NULL AND id % 6 <> 0)
SELECT title, id, doc_id % 4 = 0 AS lost FROM p JOIN m USING (project) JOIN documents ON doc_id = id""")
def kept_passages(t: Tables) -> DataFrame:
    """What projects hold after passages were put in twice, others taken out, projects deleted, and texts changed meanwhile."""
    r = Records(t.spark, folder(t, "records"))
    named = r.create_projects(t.customer.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("title"), F.lit("").alias("description"), F.lit("").alias("tags")))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    asked = t.orders.where("o_orderkey % 2 = 0").join(named, F.col("o_custkey") == F.col("key")).select(F.col("slug").alias("project"), F.col("o_orderkey").alias("id"), F.lit("q").alias("prompt"), F.lit("").alias("relevance"))
    r.add_passages(asked, texts)
    r.add_passages(asked.where("id % 4 = 0").withColumn("prompt", F.lit("again")), texts)
    r.remove_passages(asked.where("id % 6 = 0"))
    r.delete_projects(named.where("key % 7 = 0"))
    now = r.contents(texts.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))))
    titles = r.read("projects").select(F.col("slug").alias("project"), "title")
    return now.join(titles, "project").select("title", "id", "lost")


@query("""SELECT doc_id AS id, left(sha256(CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END), 16) AS hash, 64 AS width FROM documents WHERE lang <> 'de' AND text IS NOT NULL""")
def refreshed_vectors(t: Tables) -> DataFrame:
    """Fingerprints of the texts that vectors were made of, after some changed, some were new and some had gone."""
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("work"), "text")
    v = Vectors(t.spark, folder(t, "vectors"), "hashed words", hashed_words)
    works = rows.select("work").distinct()
    v.refresh(rows.where("work <> 'en' AND id % 5 <> 0"), works)
    v.refresh(rows.where("work <> 'de'").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))), works)
    return v.table.read().select("id", "hash", F.size("v").alias("width"))


def _fetcher():
    """Answers by address, as a network would: by its number found, missing, broken or too busy."""

    def ask(url: str) -> L.Answer:
        n = len(url) % 5
        if n == 4:
            raise OSError("no route")
        return L.Answer((200, 404, 429, 200)[n], url.encode(), {"Retry-After": "600"} if n == 2 else {})

    return ask


@query(r"""SELECT page_id::VARCHAR AS id, CASE WHEN length(url) % 5 IN (0, 3) THEN 'landed' WHEN length(url) % 5 = 1 THEN 'status 404' WHEN length(url) % 5 = 2 THEN 'status 429; asked to wait 600 s' ELSE 'OSError: no route' END AS outcome,
CASE WHEN length(url) % 5 = 4 THEN 2 ELSE 1 END AS attempts FROM pages WHERE page_id % 9 <> 0 UNION ALL SELECT page_id::VARCHAR, 'no address', 0 FROM pages WHERE page_id % 9 = 0""")
def landed_outcomes(t: Tables) -> DataFrame:
    """What became of all requests, after asking again for those that failed."""
    asked = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("web").alias("source"), F.when(F.col("page_id") % 9 == 0, "no address").otherwise(F.col("url")).alias("url"))
    landing, quick = L.Landing(t.spark, folder(t, "landing")), L.Manners(pause=0.0, attempts=2, first=0.0)
    landing.land(asked.where("id % 2 = 0"), _fetcher, quick)
    landing.land(asked, _fetcher, quick)
    return landing.table.read().select("id", F.when(F.col("content").isNotNull(), "landed").otherwise(F.col("error")).alias("outcome"), "attempts")


def _tei(t: Tables) -> DataFrame:
    """Documents as TEI of three archives: full stops are gaps, lines paragraphs of a division; some have no body."""
    archive = F.element_at(F.array(F.lit("epidoc"), F.lit("tcp"), F.lit("dta")), (F.col("doc_id") % 3 + 1).cast("int"))
    year = (1850 + F.col("doc_id") % 150).cast("string")
    licence = F.when(F.col("doc_id") % 4 == 0, "").when(archive == "tcp", "CC0 1.0 Public Domain").otherwise("Creative Commons BY")
    head = F.concat(F.lit("<teiHeader><title>T <hi>"), "source", F.lit("</hi></title><editionStmt><date>"), year, F.lit("</date></editionStmt><sourceDesc><date>"), year, F.lit("</date></sourceDesc><availability><licence>"), licence, F.lit("</licence></availability></teiHeader>"))
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("."), F.lit('<gap extent="1 word"/>'))
    body = F.concat(F.lit('<text><body><div type="chapter" n="1"><p>'), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div></body></text>"))
    xml = F.concat(F.lit("<TEI>"), head, F.when(F.col("doc_id") % 11 == 0, "").otherwise(body), F.lit("</TEI>"))
    return t.documents.select(F.col("doc_id").alias("id"), archive.alias("archive"), F.coalesce("lang", F.lit("en")).alias("lang"), xml.alias("xml"), F.when(F.col("doc_id") % 13 == 0, "src1").alias("wanted_title"), F.lit(None).cast("string").alias("wanted_author"))


@query(r"""WITH x AS (SELECT doc_id AS id, ['epidoc', 'tcp', 'dta'][doc_id % 3 + 1] AS archive, 1850 + doc_id % 150 AS year, doc_id % 4 <> 0 AS licensed, doc_id % 11 <> 0 AND regexp_matches(text, '[^ \t\n.]|\.' ) AS body,
CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 1 THEN length(text) - length(replace(text, '.', '')) ELSE 0 END AS lost, source, doc_id % 13 = 0 AS wants FROM documents)
SELECT id, archive, year, lost, CASE WHEN archive = 'epidoc' THEN CASE WHEN year <= least(1950, 2026 - 100) THEN 'age' WHEN year <= 1950 AND licensed THEN 'licence' END WHEN licensed THEN 'licence' END AS ground,
CASE WHEN archive = 'epidoc' AND (year > 1950 OR (year > 1926 AND NOT licensed)) OR archive <> 'epidoc' AND NOT licensed THEN 'rights' WHEN wants AND NOT contains('t ' || lower(source), 'src1') THEN 'title' ELSE 'judged by its text' END AS verdict FROM x WHERE body""")
def judged_editions(t: Tables) -> DataFrame:
    """Editions of three dialects of TEI: years, lost words, rights, and why they aren't taken."""
    found = D.evaluated(_tei(t), 2026).where("reason <> 'no body'")
    return found.select("id", "archive", "year", "lost", "ground", F.when(F.col("reason").isin("rights", "title"), F.col("reason")).otherwise("judged by its text").alias("verdict"))


@query("SELECT doc_id AS id, 'tcp' AS archive, array_to_string(list_transform(list_filter(string_split(replace(text, '.', '…'), chr(10)), lambda p: trim(p) <> ''), lambda p: trim(regexp_replace(p, '[ \\t]+', ' ', 'g'))), chr(10) || chr(10)) AS body FROM documents WHERE doc_id % 3 = 1 AND doc_id % 11 <> 0 AND regexp_matches(text, '[^ \\t\\n]')")
def edition_texts(t: Tables) -> DataFrame:
    """Texts of editions: paragraphs between blank lines under the heading line of their chapter, gaps as an ellipsis."""
    rows = D.editions(_tei(t).where("archive = 'tcp'")).where("text <> ''")
    return rows.select("id", "archive", F.regexp_replace("text", "^CHAPTER 1\n\n", "").alias("body"))
