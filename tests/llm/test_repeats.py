"""Suffix arrays and the removal of repeats against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import repeats
from quillspark.llm.suffixes import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, packed string, spans string"


def test_suffix_array():
    r = random.Random(1)
    for _ in range(2000):
        n, k = r.randrange(0, 30), r.choice([1, 2, 3, 8])
        s = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.3:
            s = (s[: r.randrange(1, n + 1)] * n)[:n]
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_gram_hashes_of_equal_grams(monkeypatch):
    r = random.Random(3)
    raw = bytes(r.choice(b"abc") for _ in range(5000))
    for chunk in (7, 1000, 1 << 18):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        repeats._powers.cache_clear()
        for k in (3, 16):
            h = repeats.gram_hashes(np.frombuffer(raw, np.uint8), k).tolist()
            assert len(h) == len(raw) - k + 1 and len(set(h)) == len({raw[i : i + k] for i in range(len(h))}) == len(set(zip(h, (raw[i : i + k] for i in range(len(h))))))
    repeats._powers.cache_clear()


def marked(strings, length):
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    return [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


def pieces(r, alphabet, n, most):
    base = bytes(r.choice(alphabet) for _ in range(r.randrange(1, most)))
    out = []
    for _ in range(n):
        t, upto = b"", r.randrange(most)
        while len(t) < upto:
            a = r.randrange(len(base))
            t += base[a : a + r.randrange(1, 300)] + bytes(r.choice(alphabet) for _ in range(r.randrange(20)))
        out.append(t)
    return out


def test_windows_of_any_strings():
    r = random.Random(2)
    for _ in range(120):
        length, gram = r.choice([40, 64, 150]), r.choice([16, 20, 30])
        texts = pieces(r, r.choice([b"ab", b"abcdefghijklmnop ", b"a", bytes(range(256))]), r.randrange(1, 8), 900)
        own, first, last, place, h = repeats.stretches(texts, length, gram)
        strings = [texts[i][a : b + length] for i, a, b in zip(own, first, last)]
        got = [[False] * max(0, len(t) - length + 1) for t in texts]
        times = Counter(zip(h.tolist(), strings))
        heads = {(g, s): p - a for g, s, p, a in zip(h.tolist(), strings, place, first)}
        if strings:
            found = repeats.repeated_windows([s for _, s in times], np.array([n > 1 for n in times.values()]), np.array([heads[x] for x in times], np.int64), length)
            by = dict(zip(times, found))
            for i, a, b, g, s in zip(own.tolist(), first.tolist(), last.tolist(), h.tolist(), strings):
                for x, y in [(0, b - a)] if times[g, s] > 1 else by[g, s]:
                    got[i][a + x : a + y + 1] = [True] * (y - x + 1)
        assert got == marked(texts, length)


def plain(rows, length=400):
    texts = [(row[1] or "").encode() for row in rows]
    out = []
    for row, t, again in zip(rows, texts, marked(texts, length)):
        gone = [False] * len(t)
        for i, yes in enumerate(again):
            if yes:
                gone[i : i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(map(str, out))


def odd_rows():
    r = random.Random(5)
    words = ["lorem", "ipsum", "été", "日本", "🙂", *[f"w{i}" for i in range(300)]]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line, long = some(90), some(14), some(700)
    texts = [None, "", " ", "short", passage, passage + "x", long, long, long + "!", "aba" * 400, "ab" * 300, "a" * 1200, line * 12]
    texts += [f"{some(r.randrange(60))} {passage} {some(r.randrange(60))}" for _ in range(12)] + [f"{some(50)} {line} {some(50)}" for _ in range(20)]
    for i in range(15):
        edited = long.split(" ")
        edited[r.randrange(len(edited))] = f"edit{i}"
        texts.append(" ".join(edited))
    texts += [some(80) for _ in range(10)] + [some(6000)]
    rows = [(r.choice([None, i, i, 2**60 + i]), t, "en", "s", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[20], rows[50]]


@pytest.mark.parametrize("limits", [{}, {"crowd": 4, "task_bytes": 20_000}])
def test_remove_repeats(spark, limits):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = repeats.remove_repeats(docs, keep_text=True, **limits).collect()
    assert sorted(str(tuple(x)[:-1]) for x in found) == plain(rows)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] and len(x["kept"]) == x["n_bytes"] - x["n_removed"] for x in found)


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1000)
    rows = odd_rows()
    assert sorted(str(tuple(x)) for x in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_remove_repeats_of_none(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "short"), (None, None)], "doc_id long, text string")
    assert sorted(str(x["n_removed"]) for x in repeats.remove_repeats(docs).collect()) == ["0", "0"]


def test_one_gram_without_repeated_windows(spark):
    r = random.Random(8)
    some = lambda n: " ".join(f"{r.randrange(10**5)}" for _ in range(n))
    passage = some(51)
    rows = [(i, f"{some(70)} {passage} {some(70)}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(x)) for x in repeats.remove_repeats(docs).collect()) == plain(rows)
