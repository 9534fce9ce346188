"""Structure and chunks against a plain version that walks through a text paragraph by paragraph."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import headings as H
from quillspark.operators import structure as S


def plain_heading(text, lang):
    line = re.sub(r"\s+", " ", text).strip(" ")
    if len(text.split("\n")) > 3 or len(line) > 90 or line[-1:] in ("?", "!"):
        return False
    capitals = line == line.upper() and re.search("[A-ZÅÄÖ]", line)
    words = line.split(" ")
    if capitals and (len(words) <= 8 or len(words) == 1 and len(line) < 24):
        return True
    found = re.search(rf"\b({H.KEYWORDS[lang]})\b", line, re.I)
    return bool(found and (found.start() == 0 or capitals))


def plain_pieces(text):
    """Sentences of a long paragraph, put together up to 1400 characters, cut at blanks where they are longer than 1800."""
    out = []
    for m in re.finditer("(?s).+?(?:(?<=[.!?])(?=\\s+[A-ZÅÄÖÜÉÈÀÇ“\"'(«])|$)", text):
        a = m.start() + len(m[0]) - len(m[0].lstrip())
        if out and m.end() - out[-1][0] <= 1400:
            out[-1][1] = m.end()
        else:
            out.append([a, m.end()])
    for a, b in out:
        while b - a > 1800:
            at = text[a : a + 1800].rfind(" ")
            step = at if at > 900 else 1800
            yield a, a + step
            a += step + (at > 900)
        if b > a:
            yield a, b


def plain_name(text):
    clean = re.sub(r"\s+", " ", re.sub(r"[.:;,\s]+$", "", text.strip()))
    if clean != clean.upper():
        return clean
    return "".join(t.upper() if re.search(H.ROMAN, t) else t[:1].upper() + t[1:] for t in re.findall(r"[^\W\d_]+|[\W\d_]+", clean.lower()))


def plain_chunks(text, lang):
    """(locator, front, start, end, text) of each chunk, by one pass with a buffer."""
    paras, at = [], 0
    for part in re.split(r"(\n\s*\n)", text):
        body = part.strip()
        if body and not re.fullmatch(r"\n\s*\n", part):
            start = at + len(part) - len(part.lstrip())
            paras.append((body, start))
        at += len(part)
    has = lambda words, x: bool(re.search(rf"\b({words[lang]})\b", re.sub(r"\s+", " ", x), re.I))
    real = [plain_heading(p, lang) for p, _ in paras]
    i = 0
    while i < len(real):
        j = i
        while j < len(real) and real[j]:
            j += 1
        if j - i >= 3:
            real[i:j] = [False] * (j - i)
        i = max(i + 1, j)
    body = [i for i, (p, _) in enumerate(paras) if real[i] and has(H.BODY, p) and not has(H.APPARATUS, p)]
    own = [i for i, (p, _) in enumerate(paras) if real[i] and not has(H.APPARATUS, p)]
    out, held, locator, under, about = [], [], None, False, None

    def front(i):
        if sum(real) < 3:
            return False
        if not body:
            return under and bool(own) and i < own[-1]
        return i < body[0] or (i > body[-1] and (locator is None or under))

    state = {"fresh": False, "last": None}

    def give():
        if held and state["fresh"]:
            t = "\n\n".join(x for x, _ in held)
            if len(t) > 120 and t != state["last"]:
                out.append((*about, held[0][1], held[-1][1] + len(held[-1][0]), t))
            state.update(last=t, fresh=False)
            del held[: -1 if len(held[-1][0]) < 700 else len(held)]

    for i, (p, start) in enumerate(paras):
        if real[i]:
            give()
            held.clear()
            locator, under = plain_name(p), has(H.APPARATUS, p)
            continue
        for a, b in list(plain_pieces(p)) if len(p) > 1800 else [(0, len(p))]:
            if held and sum(len(x) for x, _ in held) + b - a > 1400:
                give()
            if held and sum(len(x) for x, _ in held) + b - a > 1800:
                held.clear()
            if not held:
                about = (locator, front(i))
            held.append((p[a:b], start + a))
            state["fresh"] = True
            if sum(len(x) for x, _ in held) >= 900:
                give()
    give()
    return out


def text_of(r, lang):
    words = {
        "en": ["CHAPTER I.", "The book of days", "NOTES", "BOOK II", "PREFACE", "Chapter iv"], "fr": ["CHAPITRE PREMIER", "Livre II", "PRÉFACE", "Préface", "Scène ii", "Notes"],
        "sv": ["FÖRORD", "Förord", "KAPITEL XIV", "Sången om", "Sång ett"], "de": ["Hauptstück eins", "VORREDE", "Erläuterungen", "Buch II"], "it": ["CAPITOLO I", "Libro secondo", "INDICE", "Note"],
        "la": ["LIBER I", "Caput ii", "PRAEFATIO", "Index"],
    }[lang]
    out = []
    for _ in range(r.randrange(1, 60)):
        kind = r.random()
        if kind < 0.25:
            out.append(r.choice([*words, "THE WHOLE OF IT", "WHO?", "ACT ONE, THE LONG AND VERY WEARY NIGHT OF ALL THOSE MEN IN THE HOUSE", "Ärlig"]))
        elif kind < 0.9:
            out.append(" ".join(r.choice(["Étant", "one", "two.", "Three", "four!", "été", "🙂"]) for _ in range(r.randrange(1, 200))))
        else:
            out.append(r.choice(["x" * 4000, "word " * 900, "line\nline\nline\nline"]))
    return r.choice(["", "\n\n  "]) + r.choice(["\n\n", "\n \n", "\n\n\n"]).join(out) + r.choice(["", "\n"])


def test_chunks_against_one_pass(spark):
    r = random.Random(12)
    works = [(i, lang := ["en", "fr", "sv", "de", "it", "la"][i % 6], text_of(r, lang)) for i in range(90)] + [(90, "en", None), (91, "en", ""), (92, "en", "short"), (93, "en", "x" * 5000)]
    found = {}
    for x in sorted(S.chunks(spark.createDataFrame(works, "work_id long, lang string, text string")).collect(), key=lambda x: x["ordinal"]):
        found.setdefault(x["work_id"], []).append((x["locator"], x["front"], x["char_start"], x["char_end"], x["text"]))
    for i, lang, text in works:
        assert found.get(i, []) == plain_chunks(text or "", lang), i
    assert any(x[1] for rows in found.values() for x in rows) and any(x[0] for rows in found.values() for x in rows)
    assert all(len(x[4]) <= 1800 + 2 * 4 for rows in found.values() for x in rows)


def test_small_accented_headings(spark):
    told = [("sv", "Förord"), ("sv", "Sången om fåglarna"), ("fr", "Préface"), ("fr", "Scène ii"), ("de", "Hauptstück eins"), ("fr", "Épilogue")]
    rows = spark.createDataFrame(told, "lang string, line string")
    found = {x["line"]: (x["h"], x["a"]) for x in rows.select("line", H.looks_like_heading(F.col("line"), F.col("lang")).alias("h"), H.mentions(F.col("line"), F.col("lang"), H.APPARATUS).alias("a")).collect()}
    assert all(h for h, _ in found.values()) and [line for line, (_, a) in found.items() if a] == ["Förord", "Préface"]


def test_rows_are_works_whatever_their_ids(spark):
    one, two = ("CHAPTER I\n\n" + "a word " * 100 + "\n\n" + "b word " * 100), "c word " * 60
    works = spark.createDataFrame([(None, "en", one), (7, "en", one), (7, "en", two), (7, None, two)], "work_id long, lang string, text string")
    found = sorted((str(x["work_id"]), x["ordinal"], x["text"][0]) for x in S.chunks(works).collect())
    each = [(x["ordinal"], x["text"][0]) for x in S.chunks(works.where("work_id IS NULL")).collect()]
    assert found == sorted([(i, *x) for i in ("None", "7") for x in each] + [("7", 0, "c")] * 2)


def test_paragraph_offsets_cut_them_out(spark):
    text = "  one \n\n\n two\nlines\n \n\tthree  "
    rows = S.paragraphs(spark.createDataFrame([(1, "en", text), (2, "en", None)], "work_id long, lang string, text string")).orderBy("i").collect()
    assert [(x["i"], x["text"]) for x in rows] == [(0, "one"), (1, "two\nlines"), (2, "three")] and all(text[x["start"] : x["end"]] == x["text"] for x in rows)


def test_scripture(spark):
    books = [("The First Book of Moses: Called Genesis", 300), ("The Second Book of Samuel", 150), ("The Gospel According to Saint Mark", 100)]
    parts = ["The Bible", "All books of it follow."]
    for name, n in books:
        parts += [name, "Otherwise Called: Another Name", "***"] + [f"{1 + i // 50}:{1 + i % 50} And it came to pass in those days, that verse {i} was written down there." for i in range(n)] + ["A verse broken off."]
    works = [(1, "en", "\n\n".join(parts)), (2, "en", "\n\n".join(parts[:300]))]
    docs = spark.createDataFrame(works, "work_id long, lang string, text string")
    told = {x["i"]: x for x in S.verses(docs).where("work_id = 1").collect()}
    assert [told[i]["skip"] for i in range(5)] == [False, False, True, True, True] and [told[i]["front"] for i in range(4)] == [True, True, False, False]
    assert told[5]["locator"] == "Genesis 1" and told[5 + 299]["locator"] == "Genesis 6" and told[305]["locator"] == "Genesis 6"
    assert told[309]["locator"] == "2 Samuel 1" and told[306]["skip"] and told[len(parts) - 1]["locator"] == "Mark 2"
    assert not S.verses(docs).where("work_id = 2").count()
    chunks = S.chunks(docs).where("work_id = 1").collect()
    assert {x["locator"] for x in chunks} >= {"Genesis 1", "2 Samuel 3", "Mark 1"} and all("Otherwise" not in x["text"] for x in chunks)
    assert all(len({int(v) for v in re.findall(r"^(\d+):\d+ ", x["text"], re.M)}) == 1 for x in chunks)


def test_names(spark):
    told = {
        "BOOK VII.": "Book VII", "CHAPTER I. OF CIVIL MEN": "Chapter I. Of Civil Men", "SÅNGEN ÖVER FÅGELN": "Sången Över Fågeln", "Chapter iv": "Chapter iv", "MIX.": "MIX",
    }
    books = {
        "The First Book of Samuel": "1 Samuel", "The Book of the Prophet Isaiah": "Isaiah", "The First Epistle of Paul the Apostle to the Corinthians": "1 Corinthians", "The Acts of the Apostles": "Acts",
        "The Revelation of Saint John": "Revelation", "The Third Epistle General of John": "3 John", "The Lamentations of Jeremiah": "Lamentations", "The Book of Psalms": "Psalms", "Ezra": "Ezra",
    }
    for pairs, f in ((told, H.heading_name), (books, H.book_name)):
        rows = spark.createDataFrame(list(pairs.items()), "x string, want string").select("want", f(F.col("x")).alias("found")).collect()
        assert [x["found"] for x in rows] == [x["want"] for x in rows]
    one = spark.range(1).select(H.own_part(F.lit("CHAP. XIII. Of the _Naturall_ Condition")).alias("own"), H.adds_something(F.lit("The First Book")).alias("no"), H.adds_something(F.lit("Of Man")).alias("yes"), H.unit_label(F.lit("sub_book"), F.lit("1")).alias("label"), H.first_words(F.lit("a b c d e f g h i j")).alias("first")).first()
    assert tuple(one) == ("Of the Naturall Condition", False, True, "SUB BOOK 1", "a b c d e f g h…")


def test_chunk_properties_move_no_paragraphs(spark, tmp_path):
    from quillspark.plans import catalogue

    text = "\n".join(["PREFACE", "a b c d e f. " * 12, "a b c d e f. " * 12, "other words. " * 14])
    spark.createDataFrame([(1, text, "en"), (2, text, None), (3, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["chunk_properties"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, True, True, True), (2, 3, True, True, True)]
    sorts = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in x]
    assert sorts and not any(" text#" in x for x in sorts)
