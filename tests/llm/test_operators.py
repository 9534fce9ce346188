"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import bisect
import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tokenizers
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import chat, components, encoding, fingerprints, jaccard_join, language, media, mixing, quality, token_counts, toxicity, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
rng = random.Random(3)
WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "été", "straße", "日本", "🙂", "x1"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    texts = [None, "", " \n\t ", "a", "idiot!", "word " * 3000, prose(60, 1), prose(60, 1), prose(60, 2), "<|endoftext|> x"]
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", 7, 1.0, "k") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id here", None, "s0", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(600, 700)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r["v"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: root(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").split()
        out.append(frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def test_jaccard_join(spark):
    base = [prose(80, 100 + i) for i in range(30)]
    texts = list(base)
    for i, t in enumerate(base[:20]):
        for j in range(i % 4):
            w = t.split()
            w[(7 * j) % 80] = "changed"
            texts.append(" ".join(w))
    texts += [base[0]] * 4 + [None, "", " ", "one two", "one two", "one  two"]
    hot = prose(120, 999).split()
    for i in range(150):
        w = list(hot)
        w[i % 120] = f"edit{i}"
        texts.append(" ".join(w))
    s = sets(texts)
    near = [[j for j in range(len(s)) if j != i and s[i] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])] for i in range(len(s))]
    links = [len({texts[j] for j in near[i] if texts[j] != texts[i]}) for i in range(len(s))]
    label = list(range(len(s)))
    for _ in range(20):
        for i in range(len(s)):
            same = [j for j in range(len(s)) if (texts[j] or "") == (texts[i] or "")]
            label[i] = min(label[j] for j in [i, *near[i], *same])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in jaccard_join.jaccard_join(rows, small=16, block=32).collect()}
    assert [found[i]["n_links"] for i in range(len(s))] == links
    assert [found[i]["class_id"] for i in range(len(s))] == label
    assert found[0]["n_copies"] == 5


def test_jaccard_join_crowded(spark):
    """Production parameters but for nodes of 1,024, which make a crowd split on, and pairs just at the threshold that share a passage with
    thousands of texts: the pairs' words are those of no other text, the passage is 40 % of each."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(44)]
    texts = []
    for i in range(1500):
        w = [f"w{i}_{j}" for j in range(65)] + passage
        texts.append(" ".join(w))
        if i < 250:  # 25 new words in front: 105 shared shingles of 130
            w[:0] = [f"x{i}_{j}" for j in range(25)]
            texts.append(" ".join(w))
    base = [f"h{i}" for i in range(130)]
    for i in range(1300):
        w = list(base)
        w[r.randrange(130)] = f"edit{i}"
        texts.append(" ".join(w))
    s = sets(texts)
    for i in range(250):
        a, b = s[2 * i], s[2 * i + 1]
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
    crowd = range(1750, len(texts))
    found = {r["doc_id"]: r for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=1024).collect()}
    pairs = sum(found[2 * i + 1]["class_id"] == 2 * i and found[2 * i]["n_links"] == 1 for i in range(250))
    assert pairs >= 0.95 * 250
    assert all(found[i]["n_links"] == 0 for i in range(500, 1750))
    same = {}
    for i in crowd:
        same.setdefault(texts[i], []).append(i)
    assert all(found[i]["class_id"] == 1750 and found[i]["n_links"] == len(same) - 1 for i in crowd)


def test_jaccard_join_around_pivots(spark):
    """Texts at all distances from the middle of a crowd, and two crowds in one component."""
    r = random.Random(8)
    texts = []
    for c, far in ((0, 26), (1, 8)):
        base = [f"c{c}_{i}" for i in range(240)] if c == 0 else [f"c0_{i}" for i in range(200)] + [f"c1_{i}" for i in range(60)]
        for i in range(130):
            w = list(base)
            for _ in range(r.randrange(far) // 4):
                w[r.randrange(len(w))] = f"e{c}_{i}_{r.randrange(99)}"
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    s = sets(texts)
    links = [sum(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in range(len(s))) for i in range(len(s))]
    assert len(set(links)) > 20
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (16, 100):
        found = {x["doc_id"]: x["n_links"] for x in jaccard_join.jaccard_join(rows, block=block).collect()}
        assert [found[i] for i in range(len(s))] == links


def test_runs_for_recall():
    assert [round(jaccard_join.together(i), 2) for i in (1, 2, 3)] == [0.63, 0.47, 0.37]
    for level in (2, 5, 9):
        n = jaccard_join.runs_for(0.99, level)
        assert 1 - (1 - jaccard_join.together(level)) ** n >= 0.99 > 1 - (1 - jaccard_join.together(level)) ** (n - 1)


def test_links_of_many():
    r = random.Random(5)
    texts = [prose(r.randrange(0, 40), r.randrange(30)) for _ in range(120)] + ["a b", "a b c", ""]
    s = sets(texts)
    want = [[i != j and bool(s[i] & s[j]) and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in range(len(s))] for i in range(len(s))]
    assert (jaccard_join.links(texts, 5, 0.8) == np.array(want)).all()


def test_signature_forest():
    r = np.random.default_rng(2)
    sigs = r.integers(0, 2, (60, 16)).astype(np.uint32)
    parent = list(range(60))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    near = (sigs[:, None] == sigs[None]).sum(axis=2) >= 13
    for i, j in zip(*np.nonzero(near)):
        parent[root(i)] = root(j)
    edges = jaccard_join.signature_forest(sigs, 13)
    assert all(near[i, j] for i, j in edges) and len(edges) == 60 - len({root(i) for i in range(60)})


def test_jaccard_join_odd(odd, none):
    assert jaccard_join.jaccard_join(odd).count() == 12
    assert jaccard_join.jaccard_join(none).count() == 0


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (1 + i % 90), ["b", "a", None, "c"][i % 7 % 4]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in found) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(7)).collect())
    size = {s: sum(1 + i % 90 for i, _, x in rows if x == s) for s in ("a", "b", "c", None)}
    weight, total = {"a": 3, "b": 1, "c": 2, None: 3}, sum(size.values())
    level = next(v for v in np.linspace(0, 2 * total, 400_000) if sum(min(2 * size[s], weight[s] * v) for s in size) >= 1.5 * total)
    for s in size:
        own = [r for r in found if r["source"] == s]
        assert own[0]["target"] == pytest.approx(min(2 * size[s], weight[s] * level), rel=1e-3)
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=3 * 128)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["size"] == 1 + r["doc_id"] % 90 for r in found) and len(found) == 800
    assert mixing.mix_sources(odd).count() == 12 and mixing.mix_sources(none).count() == 0


def test_points_are_the_golden_ratios(spark):
    """As the Column works them out, on both sides of each carry."""
    slots = [0, 1, 2, 2**26 - 1, 2**26, 2**37 + 12345, 2**51 + 7]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in slots], "slot long").select(mixing.point(F.col("slot"))).collect()]
    assert found == [x * mixing.GOLDEN % 2**52 for x in slots]


@pytest.mark.parametrize("n_sources", [4, 1500])
def test_schedule_and_blocks_against_plain_python(spark, n_sources):
    r = random.Random(n_sources)
    rows = [(i % 500 if i % 3 else None, "w " * r.randrange(1, 40), f"s{r.randrange(n_sources)}") for i in range(3000)] + [(None, "w w w", "s1")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = docs.select("doc_id", "source", mixing.n_words().alias("size"), F.xxhash64("text").alias("t"))
    sources = mixing.source_targets(sizes).cache()
    own = sorted(({"s": x["s"], "source": x["source"], "size": x["source_size"], "target": x["target"]} for x in sources.collect()), key=lambda x: x["s"])
    assert [x["source"] for x in own] == sorted(x["source"] for x in own) and [x["s"] for x in own] == list(range(len(own)))
    for x in own:
        x["length"] = -(-x["size"] // max(1, int(x["size"] / 128 + 0.5)))
        x["blocks"] = -(-x["size"] // x["length"])
        x["part"] = max(1, round(x["target"] / x["length"] * 65536))
    slots, total = int(np.ceil(sum(x["target"] / x["length"] for x in own))), sum(x["part"] for x in own)
    ends = [int(np.floor(e / float(total) * 2.0**52)) for e in np.cumsum([x["part"] for x in own]).tolist()]
    taken, want = {}, []
    for slot in range(slots):
        x = own[bisect.bisect_right(ends, slot * mixing.GOLDEN % 2**52)]
        n = taken[x["s"]] = taken.get(x["s"], -1) + 1
        if n < 2 * x["blocks"]:
            want.append((slot, x["s"], n % x["blocks"]))
    found = mixing.schedule(sources, 128).collect()
    assert sorted((x["slot"], x["s"], x["block"]) for x in found) == want
    pieces = mixing.block_pieces(sizes, sources, 128, 5).collect()
    for x in own:
        docs_ = sorted({(p["start"], p["size"]) for p in pieces if p["s"] == x["s"]})
        assert [a for a, _ in docs_] == [sum(n for _, n in docs_[:i]) for i in range(len(docs_))] and sum(n for _, n in docs_) == x["size"]
    assert sorted((x["source"], x["size"]) for x in own) == sorted((s, sum(len(t.split()) for _, t, y in rows if y == s)) for s in {y for _, _, y in rows})
    words, times = {}, {}
    for x in found:
        times[x["s"], x["block"]] = times.get((x["s"], x["block"]), 0) + 1
    for p in pieces:
        key = p["s"], p["start"], p["doc_id"], p["size"]
        words[key] = words.get(key, 0) + p["words"] * times.get((p["s"], p["block"]), 0)
        assert p["words"] == sum(p["block"] == at // own[p["s"]]["length"] for at in range(p["start"], p["start"] + p["size"]))
    mixed = mixing.mix_sources(docs).collect()
    assert sorted(str((k[2], k[3], n)) for k, n in words.items()) == sorted(str((x["doc_id"], x["size"], x["taken"])) for x in mixed)


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (h >> 63 << 64)


def plain_sketch(text, scale=4, k=5):
    w = text.split()
    runs = [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [[" ".join(w)]] if w else []
    return {h for r in runs if (h := spark_hash(*r)) < -(1 << 63) + (1 << 64) // scale}


def plain_likeness(a, b):
    x, y = plain_sketch(a), plain_sketch(b)
    return round(len(x & y) / len(x | y), 9) if x | y else float(a == b)


def plain_edits(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    out = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        h = len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        prints = [f"{spark_hash(t) % 2**64:x}:" + ",".join(f"{x % 2**64:x}" for x in sorted(plain_sketch(t))) for t in (a, edited)]
        kept = len(plain_sketch(a) & plain_sketch(edited)) / len(plain_sketch(a)) if plain_sketch(a) else None
        out.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), *prints, plain_likeness(a, edited), plain_likeness(a, b), kept))
    return sorted(map(str, out))


def told_edits(docs, **parameters):
    found = fingerprints.fingerprint_edits(docs, **parameters).collect()
    return sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9), r["kept_in_edited"])) for r in found)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_fingerprints(odd, bits):
    assert told_edits(odd, bits=bits) == plain_edits([(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("ids", [
    [5, 2**53 + 1, 2**62 - 300, 2**62 - 1, -3, 0], [-(2**63), 2**63 - 1, 2**62, -(2**62) - 2**61, None, 1], [random.Random(4).randrange(-(2**63), 2**63) for _ in range(40)], [9],
    [None] * 30 + [7] * 30 + [6, 8, 8],
])
def test_fingerprints_of_any_ids(spark, ids):
    texts = [prose(5 + i % 9, i % 25) for i in range(len(ids))]
    assert told_edits(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), bits=1) == plain_edits(list(zip(ids, texts)))


def test_fingerprints_of_none(none):
    assert fingerprints.fingerprint_edits(none).count() == 0


def plain_chats(rows):
    """The maximal conversations of (conv_id, turn, role, text) rows, in parts of 256 turns."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn or 0, role or "", text or ""))
    told = {c: tuple(t[1:] for t in sorted(turns)) for c, turns in by.items()}
    out = []
    for whole in set(told.values()):
        same = [c for c, t in told.items() if t == whole]
        if not any(len(t) > len(whole) and t[: len(whole)] == whole for t in told.values()):
            first = min(same, key=lambda c: (c is None, c or 0))
            for a in range(0, len(whole), 256):
                chat_ = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in whole[a : a + 256])
                out.append((first, a // 256, len(whole), len(same), chat_))
    return sorted(map(str, out))


def test_chat(spark):
    said = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["z"] * 600, 6: ["z"] * 300, 7: [None, ""], None: ["a", "b", "c"], -1: ["q"], 0: ["r", None]}
    rows = [(c, 2 * i, "user" if i % 2 else None, t) for c, ts in said.items() for i, t in enumerate(ts)]
    r = random.Random(4)
    rows += [(8, r.choice([None, -5, 3, 2**40]), r.choice(["user", "x", None]), f"t{r.randrange(300)}") for _ in range(1500)]  # one block of turns, and one far away
    rows += [(None, None, None, "late")] * 1200 + [(9, 7, "user", "same")] * 1300 + [rows[3], rows[3]]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*row, 1, "clash", "clash") for row in rows], "conv_id long, turn long, role string, text string, pos int, part string, _b string")
    found = [(x["conv_id"], x["part"], x["n_turns"], x["n_copies"], x["chat"]) for x in chat.format_chats(docs).collect()]
    assert sorted(map(str, found)) == plain_chats(rows)
    assert chat.format_chats(docs.limit(0)).count() == 0


def tokenizer(name):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name)), public_tokenizers.path(name)


def test_ids_beyond_doubles_next_to_null(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string").coalesce(1)
    found = (
        media.store_texts(docs), token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json")[1]), toxicity.score(docs, toxicity.Lexicon({" words ": 1.0})),
        encoding.encode(docs, tokenizer("word_bpe_49k.json")[1]),
    )
    for out in found:
        assert {r["doc_id"] for r in out.collect()} == set(ids)


def test_token_counts(spark, odd, none):
    t, path = tokenizer("byte_bpe_50k.json")
    sizes = [(r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    found = token_counts.count_tokens(odd, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(str((*x, x[2] > 512)) for x in sizes)
    assert token_counts.count_tokens(none, path).count() == 0


def test_encoding(odd, none):
    t, path = tokenizer("word_bpe_49k.json")
    for r in encoding.encode(odd, path).collect():
        text = next(x["text"] for x in odd.collect() if x["doc_id"] == r["doc_id"]) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encoding.encode(none, path).count() == 0


def encoding_texts():
    """Words with all kinds of marks and white space, added tokens, and characters that Arrow's split and the words' pattern see differently."""
    r = random.Random(8)
    marks = ["", "", ",", "...", "'s", "'", '"', "42", "!'ll", "\x1c", "\x1f,", "\x00", "<|endoftext|>", "<|startoftext|>", "</w>", "\u0301", "Σ", "İ", "²", "ǅ", "日本", "🙂", "a" * 90, "-" * 70]
    space = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "\u180e"]
    return [*space, *marks, " a ", *("".join(r.choice(marks) + r.choice(WORDS) + r.choice(marks) + r.choice(space) for _ in range(40)) for _ in range(300))]


def test_encoding_of_pieces():
    t, path = tokenizer("word_bpe_49k.json")
    texts, coder = encoding_texts(), encoding.Texts(*encoding.bpe.load(path), remembered=500)
    for lo in range(0, len(texts), 30):
        for text, (n, ids, said) in zip(texts[lo : lo + 30], coder.encode(texts[lo : lo + 30]), strict=True):
            want = t.encode(text, add_special_tokens=False).ids
            assert (n, ids, said) == (len(want), " ".join(map(str, want)), t.decode(want, skip_special_tokens=False)), text
    assert coder.encode([]) == [] and max(map(len, coder.known)) <= encoding.LONG


def test_encoding_white_space():
    every = [f"a{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    coder = encoding.Texts(*encoding.bpe.load(tokenizer("word_bpe_49k.json")[1]))
    sizes = pc.list_value_length(pc.utf8_split_whitespace(pa.array(every, pa.large_string()))).to_pylist()
    assert {e[1] for e, n in zip(every, sizes) if (n == 2) != bool(regex.match(r"\s", e[1]))} == set(encoding.NO_SPACE)
    assert all(len(coder.pieces([f"a{c}b"])[0]) == 3 for c in encoding.NO_SPACE)


def test_encoding_cuts_each_piece_once_and_keeps_the_frequent():
    """White space alone is looked for in known texts; when too much is known, what the batch needs stays."""
    coder = encoding.Texts(*encoding.bpe.load(tokenizer("word_bpe_49k.json")[1]), remembered=60)
    cut, walked = [], []
    words, walk = coder.words_by_line, coder.encoder.encode
    coder.words_by_line = lambda text: cut.append(text) or words(text)
    coder.encoder.encode = lambda new: walked.extend(new) or walk(new)
    for i in range(40):
        coder.encode([f"lorem, ipsum! dolor's x{'abcdefghij'[i % 10]}{'klmn'[i // 10]}q"])
    assert sum(text.count("lorem") for text in cut) == 1 and walked.count("lorem") == 1 and len(coder.known) <= 70


def test_media(odd, none):
    for r in media.store_texts(odd, keep_media=True).collect():
        raw = (next(x["text"] for x in odd.collect() if x["doc_id"] == r["doc_id"]) or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        n, mean, spread, bits, blanks = r["feature"].split(";")
        shares = [payload.count(b) / len(payload) for b in set(payload)]
        assert int(n) == len(payload) and abs(float(mean) - sum(payload) / len(payload)) < 1e-3 and abs(float(spread) - np.std(list(payload))) < 1e-3
        assert abs(float(bits) + sum(p * np.log2(p) for p in shares)) < 1e-3 and abs(float(blanks) - payload.count(32) / len(payload)) < 1e-3
    assert media.store_texts(none).count() == 0


def samples_of_many_kinds():
    r = random.Random(6)
    random_bytes = bytes(r.randrange(256) for _ in range(576))
    return {
        "plain": [random_bytes, b"a" * 576, b"\xff" * 576, media.payload_of(prose(400, 3).encode()), media.payload_of((prose(50, 4) + "\n").encode() * 300)],
        "palette": [b"".join(bytes([r.choice(letters)]) * each for _ in range(5760 // each)) for letters, each in ((b"ab", 8), (b"abcd", 4))],
        "left": [bytes((3 * i + r.randrange(3)) % 256 for i in range(23040))],
        "top": [bytes((97 * (i % 24) + i // 24 + r.randrange(2)) % 256 for i in range(23040))],
    }


def test_media_chooses_transforms_by_size():
    for kind, parts in samples_of_many_kinds().items():
        assert media.kinds(parts) == [kind] * len(parts)
        for part, coded in zip(parts, media.encode_images(parts)):
            image = webp.decode(coded)
            assert image.shape == (len(part) // 24, 24, 4) and image[:, :, 1].tobytes() == part == media.decode_image(coded)
            assert not image[:, :, [0, 2]].any() and (image[:, :, 3] == 255).all()
            whole = np.dstack([image[:, :, 0], image[:, :, 1], image[:, :, 2], image[:, :, 3]])
            assert (webp.decode(webp.encode(whole)) == image).all()
            assert len(coded) <= 1.02 * len(webp.encode(whole)) + 64  # no larger than without any transform or copy


def test_media_of_any_length():
    r = random.Random(2)
    words = [prose(1, i).encode() for i in range(500)]
    for n in (24 * 16384, 24 * 16384 + 576, 576 * 16384 + 1):
        raw = b" ".join(r.choice(words) for _ in range(n // 4 + 8))[:n]
        (coded,) = media.encode_images([media.payload_of(raw)])
        assert media.decode_image(coded) == media.payload_of(raw)
    assert [media.width_of(n) for n in (576, 24 * 16384, 24 * 16384 + 576, 576 * 16384 + 576)] == [24, 24, 576, 28 * 576]


def test_references_copy_what_was_there():
    r = random.Random(3)
    s = bytes(r.choice(b"abcdefgh") for _ in range(3000)) * 3 + b"x" * 9000
    joined, owner = np.frombuffer(s, np.uint8), np.zeros(len(s), np.int64)
    here, there = media.repeats(joined, owner)
    found = media.references(s, here.tolist(), there.tolist())
    assert sum(n for _, n, _ in found) > 14_000 and all(2 <= n <= media.MOST for _, n, _ in found)
    assert all(s[a : a + n] == bytes(s[a - back + k] for k in range(n)) for a, n, back in found)
    assert all(a + n <= b for (a, n, _), (b, _, _) in zip(found, found[1:]))


def test_language(spark, odd, none):
    en, ru = "the cat and the dog were here ", "кошка и собака были здесь "
    fr = "le chat et les chiens étaient ici "
    rows = [(i, t * 5, lang) for i, (t, lang) in enumerate([(en, "en"), (ru, "ru"), (fr, "fr")] * 20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    spans = model.label([en * 4 + fr * 4, ru, "123 ..", ""], 8.0)
    assert [model.languages[k] for _, _, k, _ in spans[0]] == ["en", "fr"] and abs(spans[0][0][1] - len(en) * 4) < 12
    assert model.languages[spans[1][0][2]] == "ru" and spans[2] == spans[3] == []
    found = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == "und" and len(found) == 11
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(none)).collect()} == {"und"}


def test_language_learns_rare_ones(spark):
    texts = {"en": "the cat and the dog were here ", "ru": "кошка и собака были здесь ", "fr": "le chat et les chiens étaient ici "}
    rows = [(i, texts[lang] * 5, lang) for i, lang in enumerate(["en", "ru"] * 1000 + ["fr"] * 8)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert model.languages == ["en", "fr", "ru"]
    assert [model.languages[k] for _, _, k, _ in model.label([texts["fr"] * 4], 8.0)[0]] == ["fr"]


def test_language_learns_and_reads_by_slices(spark, monkeypatch):
    texts = pd.Series(["the house of the man", "", "la maison", "дом и мир", "x" * 70, "end of it"] * 5)
    whole, sizes, plain = language.letter_counts(texts), [], language.codes
    monkeypatch.setattr(language, "SLICE", 40)
    monkeypatch.setattr(language, "codes", lambda some: (sizes.append(sum(map(len, some[1:]))), plain(some))[1])
    assert (language.letter_counts(texts) == whole).all() and len(sizes) == 10 and max(sizes) <= 40 and whole.sum() > 0
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    model = language.Model(["en"], np.ones((language.BUCKETS, 1), np.float32), np.full(1, 1 << 0, np.uint32))
    own = language.identify(docs.select(F.struct("doc_id", "text").alias("_row")), model, keep=("_row",), inside="_row")
    assert own.columns == ["_row", "lang_pred", "score", "spans"]
    told = sorted(own.selectExpr("_row.doc_id", "_row.text", "lang_pred", "score").collect())
    assert told == sorted(language.identify(docs, model, keep=("doc_id", "text")).select("doc_id", "text", "lang_pred", "score").collect())


def test_one_language_is_exact():
    r = np.random.default_rng(1)
    m = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros(3, np.uint32))
    for _ in range(300):
        s = r.normal(0, 3, (int(r.integers(1, 30)), 3))
        lo, hi = np.array([0]), np.array([len(s)])
        best = s.sum(axis=0).argmax()
        if m.one_language(s, lo, hi, np.array([best]), 8.0)[0]:
            assert (language.viterbi(s, 8.0) == best).all()


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, k, penalty = int(r.integers(1, 7)), int(r.integers(1, 4)), float(r.uniform(0, 6))
        s = r.normal(0, 3, (n, k))

        def worth(path):
            return sum(s[t, x] for t, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

        best = max(worth(p) for p in itertools.product(range(k), repeat=n))
        assert worth(language.viterbi(s, penalty)) == pytest.approx(best)


def plain_label(model, text, penalty):
    """Word by word: runs of letters and marks, their scores, the best path, its spans."""
    words, at = [], 0
    kinds = [unicodedata.category(x)[0] for x in text]
    while at < len(text):
        if kinds[at] not in "LM":
            at += 1
            continue
        end = at
        while end < len(text) and kinds[end] in "LM":
            end += 1
        plain, bit, _ = language.letters()
        points = np.array([ord(x) for x in text[at:end]])
        score = model.weights[language.trigrams(np.array([0, *plain[points], 0], np.uint32))].sum(axis=0).astype(float)
        seen = int(np.bitwise_or.reduce(bit[points]))
        barred = np.array([seen & ~int(b) != 0 for b in model.scripts])
        score -= language.BARRED * (barred if not barred.all() else 0)
        words.append((at, score, sum(x == "L" for x in kinds[at:end])))
        at = end
    if not words:
        return []
    value, back = words[0][1].copy(), []
    for _, score, _ in words[1:]:
        move = value[:, None] - penalty * (1 - np.eye(len(value)))
        back.append(move.argmax(axis=0))
        value = move.max(axis=0) + score
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    spans = []
    for (at, _, n), k in zip(words, path):
        if spans and spans[-1][2] == k:
            spans[-1][3] += n
        else:
            if spans:
                spans[-1][1] = at
            spans.append([at, len(text), k, n])
    return [tuple(x) for x in spans]


def test_label_against_word_by_word(spark):
    said = {"en": "the cat and the dog were here ", "fr": "le chat et les chiens étaient ici ", "ru": "кошка и собака были здесь ", "hi": "बिल्ली और कुत्ता यहाँ थे "}
    rows = [(i, said[lang] * 5, lang) for i, lang in enumerate(list(said) * 20)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    r = random.Random(9)
    texts = ["", " ", "1 2", "\u0301", "e\u0301te\u0301", said["hi"], "日本 the cat", said["en"] * 3 + said["ru"] * 2 + "12, " + said["fr"] * 3]
    texts += ["".join(r.choice(list(said.values())) * r.randrange(1, 4) for _ in range(r.randrange(1, 6))) for _ in range(30)]
    for penalty in (2.0, 8.0):
        found = model.label(texts, penalty)
        for t, spans in zip(texts, found):
            assert [tuple(x) for x in spans] == plain_label(model, t, penalty), t
    # vowel signs and viramas belong to their word
    assert len(plain_label(model, "बिल्ली", 8.0)) == 1 and model.label(["बिल्ली"], 8.0)[0][0][3] == sum(unicodedata.category(x)[0] == "L" for x in "बिल्ली")
    rows = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {0, 1, 2, 3}


def labelled(spark):
    rows, told = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = prose(30, i).split()
        if toxic:
            words[10] = "IDI0T"
        text = " ".join(words)
        rows.append((i, "!! ".join(text.upper().split()) if bad else text))
        told.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, none):
    docs, labels = labelled(spark)
    rules = quality.learn(docs, labels)
    found = quality.score(docs, rules).join(labels, "doc_id").collect()
    assert rules.weights and np.mean([(r["score"] >= 0.3) == r["quality"] for r in found]) > 0.99
    scored = quality.score(odd, rules)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "score"] and scored.where("score between 0 and 1").count() == 12
    assert quality.score(odd, quality.learn(docs, labels.limit(0))).where("score = 0.5").count() == 12
    assert quality.score(none, rules).count() == 0


def plain_statistics(text):
    t = text or ""
    w, lines = [x for x in re.split("[ \t\n\x0b\f\r]+", t) if x], t.split("\n")
    share = lambda n, of: n / of if of else 0.0
    return [
        len(t), len(w), share(len(t), len(w)), share(t.count("!"), len(w)), share(t.count("|"), len(w)), share(sum(x in "*$%&#@^~=+<>{}[]\\" for x in t), len(w)),
        share(sum(unicodedata.category(x) == "Lu" for x in t), len(t)), share(sum(x in "0123456789" for x in t), len(t)), share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        share(len(set(w)), len(w)), share(len(set(lines)), len(lines)),
    ]


def test_quality_against_plain_python(spark, odd):
    texts = [r["text"] for r in odd.collect()] + ["A! B! {x} [y] a|b|c\n\na|b\n", "ÉCOLE 1234 1234", "x" * 300_000 + " end", "a\\b $5 50% #1 @me ^~=+<> *"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for r in quality.with_statistics(docs).collect():
        assert [r[c] for c in quality.STATISTICS] == pytest.approx(plain_statistics(texts[r["k"]]))
    printed = """
  Tree 0 (weight 1.0):
    If (feature 1 <= 12.5)
     If (feature 3 <= 0.25)
      Predict: 1.0
     Else (feature 3 > 0.25)
      If (feature 1 <= 3.0)
       Predict: -1.0
      Else (feature 1 > 3.0)
       Predict: 0.5
    Else (feature 1 > 12.5)
     Predict: 0.0
"""
    c = quality.Condition
    few, many = c("n_words", False, 12.5), c("n_words", True, 12.5)
    calm, loud = c("exclamations", False, 0.25), c("exclamations", True, 0.25)
    want = {(few,), (many,), (calm, few), (loud, few), (loud, c("n_words", False, 3.0)), (loud, c("n_words", False, 12.5), c("n_words", True, 3.0))}
    assert {tuple(sorted(p, key=str)) for p in quality.tree_paths(printed)} == {tuple(sorted(p, key=str)) for p in want}
    rules = quality.Rules(-0.5, {rule: 0.3 * i - 0.6 for i, rule in enumerate(sorted(want, key=str))})
    for r in quality.score(docs, rules).collect():
        own = dict(zip(quality.STATISTICS, plain_statistics(texts[r["k"]])))
        holds = lambda x: own[x.statistic] > x.bound if x.above else own[x.statistic] <= x.bound
        logit = rules.start + sum(w for rule, w in rules.weights.items() if all(map(holds, rule)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)))


@pytest.mark.parametrize("text", ["TRA$H", "tr@sh", "trаsh", "TRASH", "tra5h", "trásh", "tra\u0301sh", "t r a s h", "t.r.a.s.h", "T-R-A-S-H", "ｔｒａｓｈ", "tra\u200bsh", "$tra$h".lstrip("$")])
def test_folded_alike(text):
    lexicon = toxicity.Lexicon({" trash ": 5.0})
    assert toxicity.evidence(toxicity.fold(f"what {text} it is"), lexicon.automaton()) > 0


def test_fold_leaves_punctuation():
    assert toxicity.fold("Wow! It cost $ 50, a|b, x + y") == " wow it cost so alb x y "
    assert toxicity.fold("no! yes!") == " no yes " and toxicity.fold("") == "  "


def plain_evidence(folded, weights, exceptions):
    bare = "".join(unicodedata.normalize("NFD", c)[0] for c in folded)
    spared = [(m, m + len(p) - 1) for p in map(toxicity.fold, exceptions) for t in (folded, bare) for m in range(len(t)) if t.startswith(p, m)]
    total = 0.0
    for at in range(len(folded)):
        best = max([w for p, w in weights.items() if folded.startswith(p, at) or bare.startswith(p, at) and p.endswith(" ")], default=0.0)
        total += best if not any(a <= at < b for a, b in spared) else 0.0
    return total / np.log2(2 + folded.count(" ")) if total else 0.0


def test_matcher_against_every_place():
    r = random.Random(8)
    for _ in range(200):
        weights = {(" " + "".join(r.choice("abc") for _ in range(r.randrange(1, 4))) + r.choice(["", " "])): r.uniform(0.1, 5) for _ in range(r.randrange(0, 6))}
        exceptions = tuple(" ".join("".join(r.choice("abc") for _ in range(2)) for _ in range(2)) for _ in range(r.randrange(0, 3)))
        text = toxicity.fold(" ".join("".join(r.choice("abcàç") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 30))))
        assert toxicity.evidence(text, toxicity.Lexicon(weights, 1.0, exceptions).automaton()) == pytest.approx(plain_evidence(text, weights, exceptions))


def test_exceptions_are_learned(spark):
    rows, told = [], []
    for i in range(300):
        words = prose(30, i).split()
        if i % 3 == 0:
            words[8:9] = ["trash"]
        elif i % 3 == 1:
            words[8:9] = ["trash", "can"] if i % 30 == 1 else ["plain"]
        rows.append((i, " ".join(words)))
        told.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    own = lexicon.automaton()
    assert "trash can" in lexicon.exceptions
    assert toxicity.evidence(toxicity.fold("a trash can here"), own) == 0 < toxicity.evidence(toxicity.fold("a trash heap here"), own)


def test_a_text_labelled_both_ways_is_toxic(spark):
    rows = [(i, f"{prose(8, i % 100)} vile") if i % 2 else (i, prose(9, i)) for i in range(600)] + [(1000 + i, f"{prose(8, i % 100)} vile") for i in range(1, 600, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i % 2 == 1)) if i < 1000 else (i, 0) for i, _ in rows], "doc_id long, toxic int")
    assert " vile " in toxicity.learn(docs, told).weights


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    found = toxicity.score(docs, lexicon).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in found]) > 0.99
    by = {r["doc_id"]: r["score"] for r in toxicity.score(odd, lexicon).collect()}
    assert by[4] > 0.5 and by[0] == by[1] == by[6] == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(none, lexicon).count() == 0


def test_jaccard_join_null_and_repeated_ids(spark):
    texts = []
    for i in range(24):
        w = prose(160, 700 + i // 4).split()
        w[20 * (i % 4)] = f"edit{i}"
        texts.append(" ".join(w))
    ids = [[None, 50 + i, 7, None][i % 4] if i < 20 else None for i in range(24)]
    rows = [*zip(ids, texts), (None, texts[0]), (9, texts[20]), (2**60 + 1, prose(80, 800)), (7, prose(80, 801))]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), small=4, block=2).collect()
    s = sets(texts)
    links = [sum(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in range(24)) for i in range(24)]
    assert links == [3] * 24
    copies = [2 if i in (0, 20) else 1 for i in range(24)]
    want = [(d, 7 if i < 20 else 9, n, c) for i, (d, n, c) in enumerate(zip(ids, links, copies))]
    want += [(None, 7, 3, 2), (9, 9, 3, 2), (2**60 + 1, 2**60 + 1, 0, 1), (7, 7, 0, 1)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_shingles_by_parts(monkeypatch):
    from quillspark.llm import shingles

    texts = ["", "one", "a b c d e f", *[prose(n, n) for n in range(40)], "é 日本 " * 30]
    h, starts = shingles.shingles(texts)
    monkeypatch.setattr(shingles, "PART", 50)
    again, same = shingles.shingles(texts)
    assert (h == again).all() and (starts == same).all() and len(starts) == len(texts) + 1
    assert all((shingles.shingles([t])[0] == h[a:b]).all() for t, a, b in zip(texts, starts, starts[1:]))
    assert shingles.shingles([])[0].size == 0 and shingles.shingles([])[1].tolist() == [0]
