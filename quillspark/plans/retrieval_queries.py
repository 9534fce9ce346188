"""Retrieval: documents are passages, embeddings their vectors, sources works, and a source's number by 7 its author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import stems
from quillspark.operators import index as I
from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.plans.registry import Tables, query

TERMS = ["inther", "reand", "lamente", "queado", "erichlich", "worthless", "pathetic", "clown", "trash", "thehe"]
_TERMS = ", ".join(f"'{t}'" for t in TERMS)


def author_of(source: Column) -> Column:
    return F.concat(F.lit("author"), F.pmod(F.regexp_extract(source, "[0-9]+", 0).try_cast("int"), F.lit(7)).cast("string"))


_AUTHOR = "'author' || (try_cast(regexp_extract(source, '[0-9]+') AS INTEGER) % 7)::VARCHAR"
_DOT = "round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def query_vectors(t: Tables, n: int) -> DataFrame:
    """The vectors of one request: nine phrasings of a question, or five."""
    return t.embeddings.where(F.col("vec_id") < n).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


def all_queries(t: Tables) -> DataFrame:
    """The stated query set of searches that aren't one request: every vector whose id is divisible by 50."""
    return t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("q_label"))


def corpus(t: Tables) -> S.Corpus:
    """Sources of five documents at least count as complete works; passages under 80 characters as front matter."""
    rows = t.documents.select(
        F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("work"), F.col("source").alias("title"), author_of(F.col("source")).alias("author"), (F.col("n_chars") < 80).alias("front"),
    )
    index = search_index(t)
    return S.Corpus(rows, vectors(t).select("id", "v"), index, index.works().groupBy("work").agg(F.sum("n").alias("n")).where("n >= 5").select("work"))


def texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("work"), "text")


def search_index(t: Tables) -> I.View:
    return I.index_for(t.spark, texts(t))


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1, _VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"


def _endings(w: str, rules: dict[str, str], condition: str) -> str:
    """SQL that replaces the first ending that w has, if what is before it matches."""
    cases = [f"WHEN ends_with({w}, '{e}') THEN CASE WHEN regexp_matches(left({w}, len({w}) - {len(e)}), '{condition}') THEN left({w}, len({w}) - {len(e)}) || '{to}' ELSE {w} END" for e, to in rules.items()]
    return f"CASE {' '.join(cases)} ELSE {w} END"


_ION = "regexp_matches(left(w5, len(w5) - 3), '[st]$') AND "
_CUT = " ".join(f"WHEN ends_with(w5, '{e}') THEN CASE WHEN {_ION if e == 'ion' else ''}regexp_matches(left(w5, len(w5) - {len(e)}), '{_M1}') THEN left(w5, len(w5) - {len(e)}) ELSE w5 END" for e in stems.CUT)
#: raw and term of all distinct words: small letters without accents, then the Porter stemmer by regular expressions, for which a y in front is a consonant.
_STEMS = f"""
raws AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*')) AS raw FROM documents UNION SELECT unnest([{_TERMS}])),
p0 AS (SELECT raw, regexp_replace(strip_accents(lower(raw)), '^y', 'Y') AS w0 FROM raws),
p1 AS (SELECT *, {_endings('w0', stems.PLURALS, '')} AS w1 FROM p0),
p2 AS (SELECT *, CASE WHEN ends_with(w1, 'eed') THEN 0 WHEN ends_with(w1, 'ed') AND regexp_matches(left(w1, len(w1) - 2), '{_VOWEL}') THEN 2
       WHEN ends_with(w1, 'ing') AND regexp_matches(left(w1, len(w1) - 3), '{_VOWEL}') THEN 3 ELSE 0 END AS cut FROM p1),
p3 AS (SELECT *, left(w1, len(w1) - cut) AS bare FROM p2),
p4 AS (SELECT raw, w0, CASE WHEN ends_with(w1, 'eed') THEN CASE WHEN regexp_matches(left(w1, len(w1) - 3), '{_M0}') THEN left(w1, len(w1) - 1) ELSE w1 END
       WHEN cut = 0 THEN w1 WHEN regexp_matches(bare, '(at|bl|iz)$') THEN bare || 'e'
       WHEN bare[-1] = bare[-2] AND regexp_matches(bare, '[^aeioulsz]$') AND NOT (bare[-1] = 'y') THEN left(bare, len(bare) - 1)
       WHEN regexp_matches(bare, '{_SHORT}') THEN bare || 'e' ELSE bare END AS w2 FROM p3),
p5 AS (SELECT raw, w0, CASE WHEN ends_with(w2, 'y') AND regexp_matches(left(w2, len(w2) - 1), '{_VOWEL}') THEN left(w2, len(w2) - 1) || 'i' ELSE w2 END AS w3 FROM p4),
p6 AS (SELECT raw, w0, {_endings('w3', stems.DERIVED, _M0)} AS w4 FROM p5),
p7 AS (SELECT raw, w0, {_endings('w4', stems.ADJECTIVES, _M0)} AS w5 FROM p6),
p8 AS (SELECT raw, w0, CASE {_CUT} ELSE w5 END AS w6 FROM p7),
p9 AS (SELECT raw, w0, CASE WHEN ends_with(w6, 'e') AND (regexp_matches(left(w6, len(w6) - 1), '{_M1}') OR (regexp_matches(left(w6, len(w6) - 1), '{_M0}') AND NOT regexp_matches(left(w6, len(w6) - 1), '{_SHORT}')))
       THEN left(w6, len(w6) - 1) ELSE w6 END AS w7 FROM p8),
stems AS (SELECT raw, lower(CASE WHEN strlen(w0) NOT BETWEEN 3 AND 64 THEN w0 WHEN ends_with(w7, 'll') AND regexp_matches(w7, '{_M1}') THEN left(w7, len(w7) - 1) ELSE w7 END) AS term FROM p9)"""
_BM25 = _STEMS + rf""",
tok AS (SELECT id, term FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')) AS raw FROM documents) JOIN stems USING (raw)),
stats AS (SELECT doc_id AS id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')) AS dl FROM documents),
total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
asked AS (SELECT term, count(*) AS times FROM stems WHERE raw IN ({_TERMS}) GROUP BY term),
hits AS (SELECT term, id, count(*) AS tf FROM tok SEMI JOIN asked USING (term) GROUP BY term, id),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT id, round(sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM hits JOIN dfs USING (term) JOIN asked USING (term) JOIN stats USING (id), total GROUP BY id)"""
_KNN = f"""
knn AS (SELECT q.vec_id AS q, e.vec_id AS id, {_DOT} AS d, e.label FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) - 1 AS rank FROM knn)"""


@query(f"WITH {_BM25} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm QUALIFY rank < 100")
def bm25_top100(t: Tables) -> DataFrame:
    return R.top(I.bm25(search_index(t), I.phrases(TERMS)), [F.desc("score"), "id"], 100)


@query(r"""SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
GROUP BY term""")
def term_statistics(t: Tables) -> DataFrame:
    return R.postings(texts(t)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(r"SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS dl FROM documents")
def passage_lengths(t: Tables) -> DataFrame:
    return R.lengths(texts(t))


@query(f"WITH {_KNN} SELECT q, id, d, rank FROM near WHERE rank < 100")
def knn_top100(t: Tables) -> DataFrame:
    """The query set's nearest hundred; one request's nine vectors are the same operator's smaller case."""
    return R.nearest(vectors(t), all_queries(t), 100)


@query(f"WITH k AS (SELECT q.vec_id AS q, e.vec_id AS id, {_DOT} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.label IN (1, 4)) SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) - 1 AS rank FROM k QUALIFY rank < 100")
def knn_filtered(t: Tables) -> DataFrame:
    return R.nearest(vectors(t), all_queries(t), 100, F.col("label").isin(1, 4))


@query(f"WITH k AS (SELECT e.vec_id AS id, min({_DOT}) AS d FROM embeddings e, embeddings q WHERE q.vec_id < 5 GROUP BY e.vec_id) SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM k QUALIFY rank < 100")
def min_distance_multi(t: Tables) -> DataFrame:
    return R.nearest_to_any(vectors(t), query_vectors(t, 5), 100)


@query(f"""WITH k AS (SELECT q.vec_id AS q, e.vec_id AS id, e.label, {_DOT} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND e.label <> q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) - 1 AS rank FROM k QUALIFY rank < 60),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY rank) = 1)
SELECT q, id, round(1 - d, 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY rank) AS position FROM one QUALIFY position <= 6""")
def similar_passages(t: Tables) -> DataFrame:
    """Nearest passages of other authors (labels), one of each, six at most."""
    near = R.nearest(vectors(t), all_queries(t), 60, apart=("label",)).join(vectors(t).select("id", "label"), "id")
    one = R.ranked(near.drop("rank"), ["d", "id"], ["q", "label"], 1).drop("rank")
    return R.ranked(one, ["d", "id"], ["q"], 6).select("q", "id", F.round(1 - F.col("d"), 6).alias("similarity"), (F.col("rank") + 1).alias("position"))


LANGUAGES, MENTIONS = ("en", "fr"), ["author3", "src12", "of"]


def branches(t: Tables, c: S.Corpus) -> DataFrame:
    return S.branches(c, query_vectors(t, 9), TERMS, MENTIONS, F.col("lang").isin(*LANGUAGES))


_FUSED = f"""{_BM25},
passages AS (SELECT doc_id AS id, text, lang, source AS work, {_AUTHOR} AS author, n_chars < 80 AS front, count(*) OVER (PARTITION BY source) >= 5 AS complete FROM documents),
allowed AS (SELECT * FROM passages WHERE lang IN ('en', 'fr') AND NOT front),
fknn AS (SELECT q.vec_id AS q, e.vec_id AS id, {_DOT} AS d FROM embeddings e SEMI JOIN allowed a ON e.vec_id = a.id, embeddings q WHERE q.vec_id < 9),
fnear AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) - 1 AS rank FROM fknn),
words AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm SEMI JOIN (SELECT id FROM allowed WHERE complete) USING (id) QUALIFY rank < 100),
mworks AS (SELECT DISTINCT work FROM passages WHERE contains(lower(author), 'author3') OR contains(lower(work), 'author3') OR contains(lower(author), 'src12') OR contains(lower(work), 'src12') ORDER BY work LIMIT 40),
mids AS (SELECT a.id FROM allowed a SEMI JOIN mworks USING (work)),
md AS (SELECT id, min(d) AS d FROM fknn SEMI JOIN mids USING (id) GROUP BY id),
named AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM md QUALIFY rank < 100),
branches AS (SELECT q::BIGINT AS branch_no, 'vector' AS branch, id, rank FROM fnear WHERE rank < 100 UNION ALL SELECT 9, 'keyword', id, rank FROM words UNION ALL SELECT 10, 'mention', id, rank FROM named),
fused AS (SELECT id, round(sum(1 / (61.0::DOUBLE + rank)), 9) AS score, min(branch_no * 1000000 + rank) AS first, array_to_string(list_sort(list_distinct(list(branch))), ',') AS branches FROM branches GROUP BY id)"""


@query(f"WITH {_FUSED} SELECT id, score, first, branches FROM fused")
def fused_branches(t: Tables) -> DataFrame:
    return R.fuse(branches(t, corpus(t))).withColumn("branches", F.array_join("branches", ","))


def candidates(t: Tables) -> DataFrame:
    c = corpus(t)
    return S.candidates(c, branches(t, c))


_KEY = "trim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 120), '')"
_CANDIDATES = f"""{_FUSED},
best AS (SELECT * FROM fused ORDER BY score DESC, first LIMIT 384),
joined AS (SELECT best.*, text, source AS work, {_AUTHOR} AS author, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 120) AS k0 FROM best JOIN documents ON doc_id = id),
once AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY CASE WHEN k0 = '' THEN text ELSE k0 END ORDER BY score DESC, first) = 1),
pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) - 1 AS rank FROM once QUALIFY rank < 192),
w AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY rank) <= 3 AS kw FROM pool),
a AS (SELECT *, NOT (kw AND sum(kw::INT) OVER (PARTITION BY author ORDER BY rank) <= 4) AS overflow FROM w)"""


@query(f"WITH {_CANDIDATES} SELECT rank, id, score, work, author FROM pool")
def candidate_pool(t: Tables) -> DataFrame:
    return candidates(t).select("rank", "id", "score", "work", "author")


@query(f"WITH {_CANDIDATES} SELECT row_number() OVER (ORDER BY overflow, rank) AS position, id, score, work, author, overflow FROM a QUALIFY position <= 24")
def hybrid_search(t: Tables) -> DataFrame:
    work_cap, author_cap = R.cap_sizes(24)
    return R.diversify(candidates(t), 24, work_cap, author_cap).select("position", "id", "score", "work", "author", "overflow")


@query(f"WITH {_CANDIDATES}, p AS (SELECT row_number() OVER (ORDER BY overflow, rank) AS position, id, work FROM a QUALIFY position <= 24) SELECT id, work, row_number() OVER (ORDER BY best, position) AS shown FROM (SELECT *, min(position) OVER (PARTITION BY work) AS best FROM p)")
def grouped_by_work(t: Tables) -> DataFrame:
    best = F.min("position").over(Window.partitionBy("work"))
    return hybrid_search(t).withColumn("best", best).select("id", "work", F.row_number().over(Window.orderBy("best", "position")).alias("shown"))


@query(f"WITH {_CANDIDATES}, h AS (SELECT work FROM a ORDER BY overflow, rank LIMIT 24), k AS (SELECT source AS work FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm) JOIN documents ON doc_id = id WHERE rank < 24) SELECT DISTINCT work FROM h WHERE work NOT IN (SELECT work FROM k)")
def only_hybrid_works(t: Tables) -> DataFrame:
    words = bm25_top100(t).where("rank < 24").join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("work")), "id")
    return hybrid_search(t).select("work").distinct().join(words.select("work"), "work", "left_anti")


@query(f"WITH {_CANDIDATES}, h AS (SELECT id FROM a ORDER BY overflow, rank LIMIT 12) SELECT count(*) AS shared FROM h WHERE id IN (SELECT id FROM bm ORDER BY score DESC, id LIMIT 12)")
def overlap_top12(t: Tables) -> DataFrame:
    both = hybrid_search(t).where("position <= 12").select("id").intersect(bm25_top100(t).where("rank < 12").select("id"))
    return both.agg(F.count("*").alias("shared"))


@query(rf"""WITH {_CANDIDATES}, q AS (SELECT *, len(list_filter(['worthless', 'clown', 'the', 'was'], lambda w: list_contains(regexp_extract_all(lower(left(text, 1400)), '[\p{{L}}\p{{N}}]+'), w))) / 4.0 AS s FROM pool)
SELECT row_number() OVER (ORDER BY s DESC, rank) - 1 AS rank, id, s::DOUBLE AS pair_score FROM q""")
def reranked_pool(t: Tables) -> DataFrame:
    """The pool, scored pair by pair; the scorer is a plug, here one that counts words."""
    return S.reranked(candidates(t), {"sv": "worthless clown the was"}).select("rank", "id", F.round("pair_score", 9).alias("pair_score"))


@query(f"WITH {_CANDIDATES} SELECT work, count(*) AS passages, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM pool GROUP BY work")
def pool_histogram(t: Tables) -> DataFrame:
    """Passages of the pool by work (A08), and their share of all."""
    by = candidates(t).groupBy("work").agg(F.count("*").alias("passages"))
    return by.select("work", "passages", F.round(F.col("passages") * 100.0 / F.sum("passages").over(Window.partitionBy()), 4).alias("share"))


@query(f"WITH {_CANDIDATES} SELECT count(*) AS passages, count(DISTINCT work) AS works, count(DISTINCT author) AS authors FROM pool")
def candidate_summary(t: Tables) -> DataFrame:
    return candidates(t).agg(F.count("*").alias("passages"), F.countDistinct("work").alias("works"), F.countDistinct("author").alias("authors"))


@query(f"""WITH works AS (SELECT DISTINCT source FROM documents), m AS (SELECT source FROM works WHERE contains({_AUTHOR}, 'author3') OR contains(source, 'src12') ORDER BY source LIMIT 40),
p AS (SELECT doc_id AS id FROM documents JOIN m USING (source)), d AS (SELECT e.vec_id AS id, min({_DOT}) AS d FROM embeddings e, embeddings q WHERE q.vec_id < 5 AND e.vec_id IN (SELECT id FROM p) GROUP BY e.vec_id)
SELECT *, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM d QUALIFY rank < 100""")
def mention_branch(t: Tables) -> DataFrame:
    """Passages of the works that a mention names, by author or title, nearest to any query vector."""
    works = t.documents.select(F.col("source")).distinct().where(F.contains(author_of(F.col("source")), F.lit("author3")) | F.contains("source", F.lit("src12"))).orderBy("source").limit(40)
    of_them = t.documents.join(works, "source", "left_semi").select(F.col("doc_id").alias("id"))
    return R.nearest_to_any(vectors(t).join(of_them, "id", "left_semi"), query_vectors(t, 5), 100)


@query("""WITH g AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
size AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id), hit AS (SELECT item_id, doc_id, count(*) AS n FROM g JOIN d USING (line) GROUP BY ALL),
f AS (SELECT item_id, count(*) AS found_in, min(doc_id) AS first_doc FROM hit JOIN size USING (item_id, n) GROUP BY item_id)
SELECT item_id, coalesce(found_in, 0) AS found_in, CASE WHEN found_in IS NULL THEN 'miss' ELSE 'hit' END AS verdict, first_doc FROM size LEFT JOIN f USING (item_id)""")
def gold_check(t: Tables) -> DataFrame:
    """Which gold passages occur in the corpus: all their lines are lines of one document."""

    def lines(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, F.explode(F.split("text", "\n")).alias("line")).distinct()

    gold = lines(t.benchmark, "item_id")
    size = gold.groupBy("item_id").agg(F.count("*").alias("n"))
    there = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).join(S.if_small(gold.select("line").distinct()), "line", "left_semi").distinct()
    hits = gold.join(there, "line").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).join(size, ["item_id", "n"])
    found = hits.groupBy("item_id").agg(F.count("*").alias("found_in"), F.min("doc_id").alias("first_doc"))
    verdict = F.when(F.col("found_in").isNull(), "miss").otherwise("hit").alias("verdict")
    return size.join(found, "item_id", "left").select("item_id", F.coalesce("found_in", F.lit(0)).alias("found_in"), verdict, "first_doc")


@query("""WITH g AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), d AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT item_id, bool_and(d.line IS NOT NULL) AS covered FROM g LEFT JOIN d USING (line) GROUP BY item_id)
SELECT count(*) AS wanted, count(*) FILTER (WHERE covered) AS covered, round(count(*) FILTER (WHERE covered)::DOUBLE / count(*), 6) AS recall FROM h""")
def gold_recall(t: Tables) -> DataFrame:
    """Share of the gold passages whose lines all occur somewhere in the corpus."""
    gold = t.benchmark.select("item_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    own = S.if_small(gold.select("line").distinct())
    there = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).join(own, "line", "left_semi").distinct().withColumn("there", F.lit(True))
    by = gold.join(there, "line", "left").groupBy("item_id").agg(F.every(F.col("there").isNotNull()).alias("covered"))
    return by.agg(F.count("*").alias("wanted"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") / F.count("*"), 6).alias("recall"))


_WORDS = r"regexp_extract_all(lower(left(text, 1400)), '[\p{L}\p{N}]+')"


@query(rf"""WITH own AS (SELECT doc_id AS id, text FROM documents WHERE source = 'src3' AND n_chars >= 80 AND doc_id % 7 <> 0),
k AS (SELECT e.vec_id AS id, {_DOT} AS d FROM embeddings e SEMI JOIN own ON own.id = e.vec_id, embeddings q WHERE q.vec_id = 0),
near AS (SELECT own.*, CASE WHEN (SELECT count(*) FROM own) > 96 THEN row_number() OVER (ORDER BY d NULLS LAST, id) ELSE row_number() OVER (ORDER BY id) END AS r, d FROM own LEFT JOIN k USING (id)),
pool AS (SELECT *, len(list_filter(['worthless', 'clown', 'the', 'was'], lambda w: list_contains({_WORDS}, w))) / 4.0 AS s FROM near WHERE (SELECT count(*) FROM own) <= 96 OR (r <= 96 AND d IS NOT NULL))
SELECT row_number() OVER (ORDER BY s DESC, r) - 1 AS rank, id, s::DOUBLE AS pair_score FROM pool QUALIFY rank < 8""")
def more_of_a_work(t: Tables) -> DataFrame:
    """Further passages of one work: the nearest of them, scored pair by pair, without those that are shown."""
    shown = t.documents.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    found = S.more_from_work(corpus(t), "src3", shown, query_vectors(t, 1), {"sv": "worthless clown the was"})
    return found.select("rank", "id", F.round("pair_score", 9).alias("pair_score"))
