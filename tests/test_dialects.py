"""Documents of each archive's dialect, and what becomes of them."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import dialects as D


def body(xml):
    return f"<TEI><teiHeader><title>no</title></teiHeader><text><front>no</front><body>{xml}</body></text></TEI>"


def found(xml, archive):
    own = D.read(body(xml), D.RULES[archive])
    return [("/".join(f"{u}={n}" for u, n in path), head, text) for path, head, text in own.segments], own.gaps, own.lost


def test_milestones_reset_what_is_below_them():
    xml = """<div type="edition" n="urn:cts:x"><milestone unit="chapter" n="1"/><p>a <milestone unit="section" n="1"/>b <milestone unit="section" n="2"/>c</p>
    <milestone unit="card" n="9"/><milestone unit="chapter" n="2"/><p>d</p><milestone unit="section" n="1"/><p>e</p></div>"""
    assert [x[::2] for x in found(xml, "epidoc")[0]] == [("chapter=1", "a"), ("chapter=1/section=1", "b"), ("chapter=1/section=2", "c"), ("chapter=2", "d"), ("chapter=2/section=1", "e")]


def test_divisions_and_numbers_of_several_steps():
    xml = """<div type="translation"><div type="letter" n="text=F:book=5:letter=7"><p>one</p></div><div type="textpart" subtype="book" n="2"><head>Of <hi rend="italic">Man</hi></head><p>two <hi rend="bold">x</hi><note>no <p>no</p></note></p>
    <milestone unit="section" n="3"/><p>three</p><div n="4"><p>four</p></div><p>five</p></div><div n="praef"><p>no</p><div n="1"><p>no</p></div></div><p>six</p></div>"""
    assert found(xml, "epidoc")[0] == [
        ("text=F/book=5/letter=7", "", "one"), ("book=2", "Of _Man_", "two x"), ("book=2/section=3", "", "three"), ("book=2/part=4", "", "four"), ("book=2", "", "five"), ("", "", "six"),
    ]


def test_gaps_and_counted_divisions():
    xml = """<div type="title_page"><p>no <gap extent="1 word"/></p></div><div type="part"><head>CHAP. I. <seg rend="decorInit">O</seg>f it</head><p>be<g ref="char:EOLhyphen"/>gining <gap extent="2 letters"/> and <gap extent="1 word"><desc>〈◊〉</desc></gap>.</p></div>
    <div n="2" type="part"><div type="chapter"><p>x</p></div><div type="chapter"><lg><l>one</l><l>two</l></lg></div></div><div type="part"><p>y</p></div><div type="preface"><p>z</p></div>"""
    rows, gaps, lost = found(xml, "tcp")
    assert rows == [
        ("part=1", "CHAP. I. Of it", "begining … and …."), ("part=2/chapter=1", "", "x"), ("part=2/chapter=2", "", "one\ntwo"), ("part=3", "", "y"), ("", "", "z"),
    ] and (gaps, lost) == (3, 2)


def test_lines_are_joined():
    xml = '<div n="1"><head>Erſtes Hauptſtück</head><p>wirk-<lb/>\n liche <hi rendition="#g">Dinge</hi><lb/>\nund <hi rendition="#aq">mehr</hi><fw>fah-</fw> a <gap/>b</p><sp><speaker>N.</speaker><p>ja</p></sp></div>'
    assert found(xml, "dta")[0] == [("=1", "Erſtes Hauptſtück", "wirkliche _Dinge_ und mehr a b"), ("=1", "", "N."), ("=1", "", "ja")]


@pytest.mark.parametrize("archive", list(D.RULES))
def test_broken_documents(archive):
    for xml in ("", "<p>", "<div><div><p>a", "</div></div><p>b</p>", "<note>never closed <p>x</p>", "a < b <p>c", "<gap><gap></gap>", "<head>x", "<lb/>", "<l>", "</note>d"):
        assert all(text for _, _, text in found(xml, archive)[0])
    assert D.read("no body", D.RULES[archive]).segments == []


def test_levels():
    segment = lambda path, n: (tuple(path), "", "x" * n)
    book = [segment([("book", str(i)), ("chapter", str(j)), ("section", "1")], 1000) for i in range(3) for j in range(4)]
    assert D.level(book) == 3 and D.level([segment(p, 899) for p, _, _ in book]) == 1 and D.level([]) == 1
    assert D.level([segment([("book", "1"), ("line", str(i))], 400) for i in range(9)]) == 1


def test_tag_text(spark):
    told = [
        ("<title>Leviathan</title>", "title", "Leviathan"), ("<title>The <hi>Leviathan</hi>,\n  or  the Matter</title>", "title", "The Leviathan , or the Matter"),
        ("<author>Rold&#233; &amp; Co</author>", "author", "Roldé & Co"), ('<date when="1651">1651</date>', "date", "1651"), ("<title>Leviathan</title>", "author", None), ("<TITLE>Leviathan</TITLE>", "title", "Leviathan"),
    ]
    for xml, tag, want in told:
        assert spark.createDataFrame([(xml,)], "x string").select(D.tag_text(F.col("x"), tag)).first()[0] == want


def document(archive, title, author, year, licence, text, extra=""):
    said = f"<availability><p>{licence}</p></availability>" if archive == "tcp" else f"<licence>{licence}</licence>"
    dates = f"<editionStmt><date>{year}</date></editionStmt>" if archive == "tcp" else f"<sourceDesc><date>[{year}]</date><date>{year + 60}</date></sourceDesc>"
    names = f"<author><surname>{author}</surname><forename>F.</forename></author>" if archive == "dta" else f"<author>{author}</author>"
    return f"<TEI><teiHeader><title>{title}</title>{names}{dates}{said}</teiHeader><text><body>{text}{extra}</body></text></TEI>"


def test_one_flow_from_documents_to_verdicts(spark):
    chapters = "".join(f'<div type="chapter" n="{i}"><head>Chapter {i}. Of Things</head>' + "<p>" + f"words of the ſame work {i} here. " * 40 + "</p></div>" for i in range(1, 13))
    gaps = "<p>" + '<gap extent="1 word"/> lost. ' * 40 + "</p>"
    cc0, by = "Creative Commons 0 1.0", "Creative Commons BY"
    rows = [
        (1, "tcp", document("tcp", "Leviathan", "Hobbes", 1651, cc0, chapters), "leviathan", "hobbes", ""), (2, "tcp", document("tcp", "Leviathan", "Hobbes", 1651, "none", chapters), None, None, "rights"),
        (3, "tcp", document("tcp", "Other", "Hobbes", 1651, cc0, chapters), "Leviathan", None, "title"), (4, "tcp", document("tcp", "L", "Ross", 1651, cc0, chapters), None, "Hobbes", "author"),
        (5, "tcp", document("tcp", "L", "H", 1651, cc0, chapters, gaps), None, None, "lost words"), (6, "tcp", document("tcp", "L", "H", 1651, cc0, "<p>short</p>"), None, None, "too short"),
        (7, "tcp", document("tcp", "L", "H", 1651, cc0, ""), None, None, "no body"), (8, "tcp", None, None, None, "no body"), (9, "epidoc", document("epidoc", "Letters", "Cicero", 1908, "", chapters), None, None, ""),
        (10, "epidoc", document("epidoc", "Letters", "Cicero", 1940, by, chapters), None, None, ""), (11, "epidoc", document("epidoc", "Letters", "Cicero", 1940, "", chapters), None, None, "rights"),
        (12, "epidoc", document("epidoc", "Letters", "Cicero", 1960, by, chapters), None, None, "rights"), (13, "dta", document("dta", "Kritik", "Kant", 1781, "gemeinfrei", chapters), None, "kant, f", ""),
        (14, "tcp", document("tcp", "L", "H", 1651, cc0, "<p>" + "word " * 2500 + "</p>"), None, None, "few chunks"),
    ]
    docs = spark.createDataFrame([(i, a, x, t, w) for i, a, x, t, w, _ in rows], "id long, archive string, xml string, wanted_title string, wanted_author string").withColumn("lang", F.lit("en"))
    told = {r["id"]: r for r in D.evaluated(docs, 2026).collect()}
    assert {i: r["reason"] for i, r in told.items()} == {i: why for i, *_, why in rows}
    assert told[5]["lost"] == 40 and told[5]["lost_per_1000"] > 4 and told[1]["lost_per_1000"] == 0 and told[9]["ground"] == "age" and told[10]["ground"] == "licence" and told[13]["author"] == "Kant, F."
    assert told[1]["year"] == 1651 and told[13]["year"] == 1781 and told[1]["chunks"] >= 12
    text = told[1]["text"].split("\n\n")
    assert text[0] == "CHAPTER 1 — OF THINGS" and text[2] == "CHAPTER 2 — OF THINGS" and "ſ" not in told[1]["text"] and "ſ" in told[9]["text"] and told[9]["text"].startswith("CHAPTER 1 — CHAPTER 1. OF THINGS\n\n")
    assert told[13]["text"].startswith("CHAPTER 1. OF THINGS\n\n")


def test_each_document_is_judged_by_its_own_text_and_read_once(spark):
    chapters = "".join(f'<div type="chapter" n="{i}"><p>' + f"words of the work {i} here. " * 60 + "</p></div>" for i in range(1, 8))
    whole, short = document("tcp", "L", "H", 1651, "Creative Commons 0 1.0", chapters), document("tcp", "L", "H", 1651, "Creative Commons 0 1.0", "<p>short</p>")
    docs = spark.createDataFrame([(1, "tcp", whole), (1, "tcp", whole), (None, "tcp", whole), (1, "tcp", short)], "id long, archive string, xml string")
    docs = docs.withColumns({"lang": F.lit("en"), "wanted_title": F.lit(None).cast("string"), "wanted_author": F.lit(None).cast("string")})
    told = D.evaluated(docs, 2026)
    counts = [r["chunks"] for r in told.orderBy(F.length("text")).collect()]
    assert counts[0] == 0 and counts[1] == counts[2] == counts[3] == 7
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_headings_stay_short(spark):
    long = "On the many and various ways in which men of all kinds have lived in this land since the days of old"
    xml = body(f'<div type="preface"><head>{long}</head><p>a</p></div><div type="chapter" n="3"><head>CHAP. III. {long}</head><p>b</p><p>c</p></div>')
    docs = spark.createDataFrame([(1, "tcp", xml), (2, "nowhere", xml)], "id long, archive string, xml string")
    rows = {r["id"]: r["lines"] for r in D.read_documents(docs).select("id", D.heading_lines(F.col("segments"), F.col("archive")).alias("lines")).collect()}
    assert rows[1] == ["ON THE MANY AND VARIOUS WAYS IN WHICH…", "CHAPTER 3 — ON THE MANY AND VARIOUS WAYS IN WHICH MEN OF ALL KINDS HAVE LIVED IN…", None] and rows[2] == []
    assert all(len(x) <= 88 for x in rows[1] if x)
