"""Folding, prefix joins and orders against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import orders as O
from quillspark.operators.prefixes import mentioned, prefix_join


def plain_fold(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ").lower()
    for a, b in (("ø", "o"), ("æ", "ae"), ("œ", "oe"), ("ð", "d"), ("þ", "th"), ("ł", "l"), ("ß", "ss")):
        s = s.replace(a, b)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s).split())


def test_fold_every_letter(spark):
    letters = [chr(c) for c in range(0x20, 0x3000) if chr(c).isalpha()]
    texts = [*letters, *[unicodedata.normalize("NFD", c) for c in letters], "Ærø ÉTÉ—Straße!", "", "ﬁ 日本 É́"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f")).collect()
    odd = [(r["t"], r["f"], plain_fold(r["t"])) for r in rows if r["f"] != plain_fold(r["t"])]
    assert not odd, odd[:9]


@pytest.mark.parametrize("bucket", [1, 3, 8])
def test_prefix_join(spark, bucket):
    r = random.Random(bucket)
    some = lambda n: "".join(r.choice("abå") for _ in range(r.randrange(n)))
    words = [(i, some(7) if i % 9 else None) for i in range(300)] + [(900 + i, "aaaaaaaaaab") for i in range(50)]
    names = [(i, some(5) if i % 7 else None) for i in range(60)] + [(90, "aaaaaaaaaa"), (91, "aaaaaaaaaab"), (92, "aaaaaaaaaabb")]
    found = prefix_join(spark.createDataFrame(words, "w long, word string"), spark.createDataFrame(names, "n long, name string"), "word", "name", bucket)
    want = [(i, w, j, n) for i, w in words for j, n in names if w and n and w.startswith(n)]
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_mentioned(spark):
    asked = spark.createDataFrame([(1, "Vad säger Platon om Émile?"), (2, ""), (3, None), (4, "dostojevskij PLATO")], "question long, text string")
    people = spark.createDataFrame([("p", "Plato"), ("d", "Dostoyevsky"), ("e", "ÉMILE Zola"), ("s", "om"), (None, None)], "person string, name string")
    assert sorted(tuple(x) for x in mentioned(asked, people).collect()) == [(1, "e"), (1, "p"), (4, "p")]


def swedish(name):
    order = "abcdefghijklmnopqrstuvwxyzåäö"
    return [order.index(c) for c in name.lower()]


def test_swedish_order_in_pages(spark):
    r = random.Random(2)
    authors = ["zebra", "åsa", "ärlig", "öl", "az", "ann", "ång", "aöa", "aza"]
    rows = [(r.choice(["drama", "verse", None]), a := r.choice([*authors, None]), r.choice([None, 1800, 1801]), r.choice(["b", "a", "ä", "å"]), i) for i in range(200)]
    found = O.listed(spark.createDataFrame(rows, "section string, author string, year int, title string, id long"), "section", "author", "year", "title", page=7).collect()
    for section in ("drama", "verse", None):
        own = sorted((x for x in found if x["section"] == section), key=lambda x: x["place"])
        assert [x["place"] for x in own] == list(range(1, len(own) + 1)) and all(x["page"] == (x["place"] - 1) // 7 for x in own)
        keys = [(x["author"] is not None, swedish(x["author"] or ""), x["year"] is not None, x["year"] or 0, swedish(x["title"])) for x in own]
        assert keys == sorted(keys)
    assert len(found) == 200
    alike = spark.createDataFrame([("Écho", "echo"), ("ål", "al"), ("PLATO", "plato")], "a string, b string").select((O.collated(F.col("a"), exact=False) == O.collated(F.col("b"), exact=False)).alias("x"))
    assert [x["x"] for x in alike.collect()] == [True, False, True]


def test_display_order_and_archive_filter(spark):
    rows = spark.createDataFrame([("m1", " Vad  är\nJaget"), ("m2", "vad är jaget?"), ("m1", None), ("m3", "annat"), (None, "vad är jaget")], "model string, prompt string")
    assert [(x["model"], x["n"]) for x in O.tallied(rows, "model", ["m2", "none", "m1"]).collect()] == [("m2", 1), ("m1", 2), (None, 1), ("m3", 1)]
    assert sorted(x["model"] for x in O.archive_filter(rows, ["m1", "m2"], "VAD ÄR  jaget").collect()) == ["m1", "m2"]
    assert O.archive_filter(rows, [], " är ").count() == 3 and O.archive_filter(rows, ["m3"], "").count() == 1
