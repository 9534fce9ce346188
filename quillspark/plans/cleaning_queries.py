"""Cleaning functions on pages, documents and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import clean as C
from quillspark.plans.registry import Tables, query


def _entities(x: str) -> str:
    """DuckDB SQL that decodes the entities of an expression."""
    name = "regexp_extract(p, '^(#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[a-zA-Z]+);', 1)"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in C.ENTITIES.items()) + "}"
    char = f"""CASE WHEN regexp_matches({name}, '^#[xX]') THEN chr(('0x' || {name}[3:])::INTEGER) WHEN starts_with({name}, '#') THEN chr({name}[2:]::INTEGER) ELSE {known}[{name}] END"""
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {char} IS NULL THEN '&' || p ELSE {char} || substr(p, length({name}) + 2) END), '')"


def _plain(x: str) -> str:
    """DuckDB SQL that turns a page into text."""
    out = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    out = f"regexp_replace({out}, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<h[1-6][^>]*>', chr(10) || chr(10) || chr(1), 'gi'), '</h[1-6]>', chr(2) || chr(10) || chr(10), 'gi')"
    head = _entities("regexp_replace(split_part(h, chr(2), 1), '<[^>]*>', ' ', 'g')")
    line = rf"upper(replace(trim(regexp_replace({head}, '[ \t\r\n]+', ' ', 'g')), 'ß', 'SS'))"
    out = f"array_to_string(list_transform(string_split({out}, chr(1)), lambda h, j: CASE WHEN j > 1 AND contains(h, chr(2)) THEN {line} || substr(h, length(split_part(h, chr(2), 1)) + 2) ELSE h END), '')"
    out = f"regexp_replace(replace({out}, chr(2), ''), '<br[^>]*>', chr(10), 'gi')"
    out = rf"regexp_replace({out}, '</?({C.BLOCKS})([ \t\r\n][^>]*)?>', chr(10) || chr(10), 'gi')"
    out = _entities(f"regexp_replace({out}, '<[^>]*>', '', 'g')")
    out = rf"regexp_replace(regexp_replace({out}, '[ \t\r]*\n[ \t\r]*', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


@query(f"SELECT page_id, {_plain('html')} AS plain FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", C.html_to_text(F.col("html")).alias("plain"))


@query(f"SELECT p_partkey, {_entities(chr(39) + '&#' + chr(39) + ' || (p_size + 60) || ' + chr(39) + ';&eacute;&none;&#x' + chr(39) + ' || p_size || ' + chr(39) + '; & &' + chr(39) + ' || p_name')} AS decoded FROM part")
def entities(t: Tables) -> DataFrame:
    coded = F.concat(F.lit("&#"), (F.col("p_size") + 60).cast("string"), F.lit(";&eacute;&none;&#x"), F.col("p_size").cast("string"), F.lit("; & &"), F.col("p_name"))
    return t.part.select("p_partkey", C.decode_entities(coded).alias("decoded"))


@query(r"""WITH x AS (SELECT doc_id, source || chr(10) || '*** START OF IT ***' || chr(10) || text || '  ' || chr(10) || CASE WHEN n_chars > 500 THEN '*** END OF IT ***' || lang ELSE '' END AS raw FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(split_part(substr(raw, instr(raw, '*** START OF IT ***') + 19), '*** END OF IT ***', 1), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM x""")
def boilerplate(t: Tables) -> DataFrame:
    end = F.when(F.col("n_chars") > 500, F.concat(F.lit("*** END OF IT ***"), F.coalesce("lang", F.lit("")))).otherwise("")
    raw = F.concat(F.coalesce("source", F.lit("")), F.lit("\n*** START OF IT ***\n"), F.col("text"), F.lit("  \n"), end)
    return t.documents.select("doc_id", C.without_boilerplate(raw, r"\*\*\* START OF IT \*\*\*", r"\*\*\* END OF IT \*\*\*").alias("body"))


@query("SELECT doc_id, replace(replace(replace(replace(text, 's', 's'), 'ſ', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS today FROM (SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), 'is', 'iſ') AS text FROM documents)")
def old_letters(t: Tables) -> DataFrame:
    old = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("is"), F.lit("iſ"))
    return t.documents.select("doc_id", C.todays_letters(old).alias("today"))


@query(r"SELECT doc_id, regexp_replace(text, '(\p{L})[-¬⸗]\n[ \t]*(\p{Ll})', '\1\2', 'g') AS joined FROM (SELECT doc_id, replace(text, 'tion', 'ti-' || chr(10) || '  on') AS text FROM documents)")
def joined_hyphens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.without_hyphens(F.replace("text", F.lit("tion"), F.lit("ti-\n  on"))).alias("joined"))


@query(r"SELECT p_partkey, p_name || '—' || p_type AS locator FROM part")
def clean_locators(t: Tables) -> DataFrame:
    """Locators without emphasis marks, notes in brackets and doubled hyphens."""
    raw = F.concat(F.lit("_"), F.col("p_name"), F.lit("_--"), F.col("p_type"), F.lit(" [note] "))
    return t.part.select("p_partkey", C.clean_locator(raw).alias("locator"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), ''), 'search') || '.md' AS file FROM conversations""")
def export_names(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", C.file_name(F.col("text"), "md").alias("file"))


@query("""SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def cosines(t: Tables) -> DataFrame:
    """Cosines to one vector, from Euclidean distances."""
    one = t.embeddings.where("vec_id = 0").select("embedding").first()
    wanted = F.lit([float(x) for x in one[0]]) if one else F.array().cast("array<double>")
    d = F.sqrt(F.aggregate(F.zip_with("embedding", wanted, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(C.cosine_of_distance(d), 4).alias("cosine"))


@query("""WITH hits AS (SELECT p_partkey, p_name, unnest(list_concat(list_transform(list_filter(range(length(p_name)), lambda i: substr(p_name, i + 1, 3) = 'dge'), lambda i: {'s': i, 'e': i + 3}),
 list_transform(list_filter(range(length(p_name)), lambda i: substr(p_name, i + 1, 3) = 'wid'), lambda i: {'s': i, 'e': i + 3}))) AS r FROM part),
m AS (SELECT p_partkey, r.s AS s, r.e AS e, CASE WHEN r.s <= max(r.e) OVER (PARTITION BY p_partkey ORDER BY r.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hits),
g AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey ORDER BY s) AS n FROM m)
SELECT p_partkey, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM g GROUP BY p_partkey, n""")
def highlight_ranges(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.explode(C.highlights(F.col("p_name"), ["dge", "wid"])).alias("r"))
    return rows.select("p_partkey", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))
