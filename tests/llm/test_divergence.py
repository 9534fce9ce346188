"""The divergence audit against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, counts string, value string"


def plain(rows, least_docs=3, top=200):
    docs = [tuple(x or "" for x in (text, lang, source)) for _, text, lang, source, *_ in rows]
    found = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
    out = []
    for lang in {d[1] for d in docs}:
        held, groups = Counter(), {}
        for text, la, source in docs:
            if la == lang:
                held.update(set(found(text)))
                groups.setdefault(source, Counter()).update(found(text))
        kept = [t for t, n in held.items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pair = [(u, sum((p[s][t] - p[u][t]) ** 2 // p[u][t] for t in kept)) for u in groups if u != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, 10**9), ("term", term, top)):
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))) if i < most]
    return sorted(map(str, out))


def odd_rows():
    r = random.Random(7)
    words = ["Lorem", "ipsum", "été", "ÉTÉ", "straße", "日本", "🙂x", "a1b", "don't", "\x7f", "x_y", "Z"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(r.choice([None, i]), some(r.randrange(12)), r.choice(["en", "fr", None, ""]), r.choice(["s0", "s0", "s0", "s1", "S1", "é", None]), 1, "clash", "clash", "clash") for i in range(80)]
    rows += [(1, None, "en", "only null", None, None, None, None), (2, "", "lone", "s0", None, None, None, None), (3, "word " * 5000, "en", "long", 1, None, None, None)]
    return [*rows, *rows[:5], (4, "seldom", "none kept", "a", 0, "", "", ""), (5, "words", "none kept", "b", 0, "", "", "")]


@pytest.mark.parametrize("top", [200, 2])
def test_divergence(spark, top):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(str(tuple(x)) for x in divergence.divergence(docs, top=top).collect()) == plain(rows, top=top)


def test_divergence_of_none(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_share_of_large_counts(spark):
    r = random.Random(1)
    rows = [(c := r.randrange(10**13), c + r.randrange(10**13), r.randrange(1, 10**9)) for _ in range(200)] + [(0, 0, 1), (9 * 10**13 - 1, 9 * 10**13, 10**6)]
    found = spark.createDataFrame(rows, "c long, n long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(x["p"] == 1 + 10**9 * (x["c"] + 1) // (x["n"] + x["v"]) for x in found) and len(found) == len(rows)
