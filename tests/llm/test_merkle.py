"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest

from quillspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, at string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return out


def leaf(row, text):
    told = [None if x is None else str(x) for x in (row[0], row[3], row[2], row[4], text)]
    return sha("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in told))


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s] = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [levels([leaf(r, r[1]) for r in by[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for at, row in enumerate(by[s]):
            path = siblings(trees[k], at) + siblings(top, k)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            d = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]) if bad else row[1])
            for before, after in path:
                d = sha("".join([*before, d, *after]))
            root = top[-1][0]
            out.append((row[0], trees[k][0][at], trees[k][-1][0], root, sha("".join("".join(b + a) for b, a in path)), d, d == root, s))
    return sorted(map(str, out))


def rows_of(n, sources, seed):
    r = random.Random(seed)
    texts = [None, "", "Some Words", "plain words", "ÉTÉ É", "🙂 X" * 500]
    rows = [(r.choice([None, i, i, 7]), r.choice(texts), r.choice(["en", None]), r.choice([None, "", "a", "é", "\U0001f642", "￿", *[f"s{k}" for k in range(sources)]] + ["hot"] * sources), r.choice([None, 3]), "x", "y", "z") for i in range(n)]
    return rows + rows[: n // 20]


@pytest.mark.parametrize("n,sources,per", [(900, 30, 16), (900, 30, 16_384), (420, 300, 7), (1, 1, 8)])
def test_manifest(spark, n, sources, per):
    rows = rows_of(n, sources, n)
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), per=per)
    assert sorted(str(tuple(x)) for x in found.collect()) == plain(rows)


@pytest.mark.parametrize("n", [2, 16, 17, 257])
def test_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "only", i, "", "", "") for i in range(n)]
    assert sorted(str(tuple(x)) for x in merkle.manifest(spark.createDataFrame(rows, SCHEMA), per=5).collect()) == plain(rows)


def test_manifest_of_none(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forests_merge_in_any_order():
    r = random.Random(4)
    sizes = [1, 2, 16, 17, 300, 5]
    nodes = [(t, 0, i, n, sha(f"{t} {i}")) for t, n in enumerate(sizes) for i in range(n)]
    trees = [levels([sha(f"{t} {i}") for i in range(n)]) for t, n in enumerate(sizes)]
    root = levels([t[-1][0] for t in trees])[-1][0]
    for _ in range(5):
        r.shuffle(nodes)
        cuts = sorted(r.sample(range(len(nodes)), 6))
        parts = [nodes[a:b] for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
        seen = []
        while len(parts) > 1:
            a, b = parts.pop(r.randrange(len(parts))), parts.pop(r.randrange(len(parts)))
            forest = merkle.Forest(len(sizes))
            seen += forest.merge(a)
            seen += forest.merge(b)
            parts.append(forest.nodes())
        assert [x[4] for x in parts[0]] == [root]
        assert sorted(x[:3] for x in seen) == sorted([(t, k, i) for t, tree in enumerate(trees) for k, level in enumerate(tree[: max(1, len(tree) - 1)]) for i in range(-(-len(level) // 16))] + [(-1, 0, 0)])
