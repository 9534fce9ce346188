"""Pages, mark-up and letters that SQL can't check."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import clean as C
from quillspark.sources import catalogs as S
from quillspark.sources import tei

XML = """<?xml version="1.0"?><TEI xmlns="x"><teiHeader><title>No</title></teiHeader><text><front><p>no</p></front><body>
<div type="edition"><div type="textpart" subtype="book" n="1"><head>Of <hi rend="italic">Man</hi></head>
<p>First <note>not this <p>nor this</p></note>para&#8212;graph<lb/>goes on, with a bro-<lb/>ken word.</p>
<div subtype="chapter"><milestone unit="section" n="2"/><p>Second &amp; <emph>third</emph>.</p></div><div subtype="chapter"><head>The Last</head><lg><l>one</l><l>two</l></lg></div></div>
<!-- <p>no</p> --></div></body></text></TEI>"""


def test_tei_segments(spark):
    found = list(tei.segments(XML))
    assert found == [
        ("BOOK 1", "Of _Man_", "First para—graph\ngoes on, with a broken word."), ("BOOK 1, CHAPTER 1, SECTION 2", "Of _Man_", "Second & _third_."),
        ("BOOK 1, CHAPTER 2", "The Last", "one"), ("BOOK 1, CHAPTER 2", "The Last", "two"),
    ]
    rows = tei.tei_segments(spark.createDataFrame([(1, XML), (2, None), (3, ""), (4, "<p>open <b")], "work_id long, xml string")).orderBy("work_id", "i").collect()
    assert [(r["path"], r["head"], r["text"]) for r in rows if r["work_id"] == 1] == found and [r["text"] for r in rows if r["work_id"] == 4] == ["open b"]


def test_wiki_text_and_properties(spark):
    html = '<div class="ws-noexport x"><div>in</div> nav </div><p>One<span class="pagenum">[3]</span> two.</p><div>kept</div><span itemprop="author"><span itemprop="name">A <b>B</b></span></span>'
    row = spark.createDataFrame([(html,)], "html string").select(S.wiki_text(F.col("html")).alias("text"), S.item_property(F.col("html"), "author").alias("author"), S.item_property(F.col("html"), "translator").alias("none")).first()
    assert "nav" not in row["text"] and row["text"].startswith("One two.") and "kept" in row["text"] and "[3]" not in row["text"] and (row["author"], row["none"]) == ("A B", None)
    broken = spark.createDataFrame([('<div class="ws-noexport">never closed <p>x',), (None,)], "html string").select(S.wiki_text(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in broken] == ["", None]


@pytest.mark.parametrize("f,pairs", [
    (C.without_emphasis, {"a _b c_ d": "a b c d", "snake_case_name": "snake_case_name", "_a_ _b_": "a b", "_ a_": "_ a_"}),
    (C.clean_locator, {"_Book_ 1--2 [note] ": "Book 1—2"}),
    (C.todays_letters, {"ſtaﬀ ﬁﬂ": "staff fifl", "buͤcher Ärger été ñ": "bücher Ärger été ñ", "plain": "plain"}),
    (C.decode_entities, {"a &amp; b &#233;&#xE9; &zz; &#0; &#1114112; &#xD800; &": "a & b éé &zz; &#0; &#1114112; &#xD800; &", "": "", "&AMP;&Auml;": "&AMP;Ä"}),
    (C.html_to_text, {"<h2>The <b>Last</b>\n part<br>of&nbsp;it &amp; all</h2>x<p>y<br>z</p><h1></h1>": "THE LAST PART OF IT & ALL\n\nx\n\ny\nz", "<section>a</section>b<!-- no -->": "ab"}),
    (C.without_hyphens, {"bro-\n ken Up-\nTo": "broken Up-\nTo"}),
    (lambda c: C.file_name(c, "md"), {"Vad är Jaget?": "vad-är-jaget.md", "??": "search.md"}),
    (lambda c: C.without_boilerplate(c, "START", "END"), {"x\r\nSTART\r\na  \n\n\n\nb\nEND y": "a\n\nb", "no marks ": "no marks", "START only": "only"}),
    (lambda c: S.cts_field(c, "title"), {"<ti:title xml:lang='x'>A <i>b</i>\n c</ti:title>": "A b c", "<title>no</title>": None}),
])
def test_functions(spark, f, pairs):
    rows = spark.createDataFrame(list(pairs.items()), "x string, want string").select("want", f(F.col("x")).alias("found")).collect()
    assert [r["found"] for r in rows] == [r["want"] for r in rows]


def test_highlights_merge(spark):
    rows = spark.createDataFrame([("banana bandana",), ("",), ("xyz",)], "t string").select(C.highlights(F.col("t"), ["an", "na", "ban"]).alias("r")).collect()
    assert [[tuple(x) for x in r["r"]] for r in rows] == [[(0, 6), (7, 10), (11, 14)], [], []]
