"""Passages of many words that different rows share, against plain Python."""

import random
from collections import defaultdict

import pytest

from quillspark.llm import passages, repeats

SCHEMA = "doc_id long, text string"


def rows():
    r = random.Random(4)
    vocabulary = ["a", "été", "日本", "enie", *[f"w{i}" for i in range(400)]]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    short, near, line, long, twice = some(51), some(50), some(20), some(300), some(60)
    texts = [None, "", " \n", "short", " ".join(short), "\n".join(["x", *short]), "enie " * 300, "enie " * 50, " ".join(twice * 2)]
    texts += [" ".join(some(r.randrange(80)) + short + some(r.randrange(80))) for _ in range(6)]
    texts += [" ".join([*some(r.randrange(80)), f"l{i}", *near, f"r{i}", *some(r.randrange(80))]) for i in range(6)]
    texts += [" ".join(some(60) + line + some(60)) for _ in range(20)]
    for i in range(8):
        edited = list(long)
        for _ in range(r.randrange(12)):
            edited[r.randrange(len(edited))] = f"edit{i}"
        texts.append(r.choice([" ", "\t", " \n"]).join(edited))
    texts += [" ".join(some(2000)), " ".join(some(90)), "y" * 5000, f"{'z' * 3000} {' '.join(some(70))}"]
    return [(r.choice([None, i, 2**60 + i]), t) for i, t in enumerate([*texts, texts[-3]])]


def plain(found, words):
    seen = defaultdict(set)
    split = [(t or "").split() for _, t in found]
    for i, s in enumerate(split):
        for k in range(len(s) - words + 1):
            seen[tuple(s[k : k + words])].add(i)
    told = {i for own in seen.values() if len(own) > 1 for i in own}
    return sorted(str((*row, int(i in told))) for i, row in enumerate(found))


def test_parts_have_each_window_once():
    r = random.Random(6)
    for _ in range(300):
        words = r.choice([1, 2, 5])
        text = b"".join(r.choice([b"a", b"bcd", b"e" * 40]) + r.choice([b" ", b"\n\t", b"   "]) for _ in range(r.randrange(60)))
        windows = lambda t: [tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)]
        assert [w for p in passages.parts(text, words, r.choice([1, 20, 100])) for w in windows(p)] == windows(text)


@pytest.mark.parametrize("limits", [{}, {"run": 3, "size": 700, "task_bytes": 500}])
def test_shared_passages(spark, limits):
    found = rows()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(found)], SCHEMA).repartition(4)
    base = repeats._packed(docs)
    rows_told = passages.shared_passages(base, 51, **limits).collect()
    told = {x["doc_id"] for x in base.where(base["row"].isin([x["row"] for x in rows_told])).collect()}
    assert len(rows_told) == len(told)
    assert sorted(str((*row, int(i in told))) for i, row in enumerate(found)) == plain(found, 51)


def test_short_passages_are_told_and_stay(spark, tmp_path):
    """A shared passage of 51 words but under 400 bytes: nothing is removed, but the query tells it."""
    from quillspark.llm.queries import op11_suffix_dedup

    r = random.Random(8)
    some = lambda n: " ".join(f"{r.randrange(10**5)}" for _ in range(n))
    passage, near = some(51), some(50)
    texts = [f"{some(70)} {p} {some(70)}" for p in (passage, passage, near, near, some(51))]
    spark.createDataFrame(list(enumerate([*texts, None])), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(op11_suffix_dedup(spark, str(tmp_path)).collect())
    assert len(passage) < 400 and [x["n_removed"] for x in found] == [0] * 6
    assert [x["shared_passage"] for x in found] == [1, 1, 0, 0, 0, 0]
    assert found[0].asDict().keys() >= {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}


def test_no_shared_passages(spark):
    docs = spark.createDataFrame([(1, "one two three"), (None, None)], SCHEMA)
    assert [x["shared_passage"] for x in repeats.remove_repeats(docs, words=51).collect()] == [0, 0]
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA), words=51).count() == 0
