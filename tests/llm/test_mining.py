"""Toxicity, phrases and hard negatives: brute force, held-out labels, awkward rows."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor

import duckdb
import numpy as np
import pytest

from reuselake.llm import hardneg, phrases, toxicity
from reuselake.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import awkward, frame, labels

PATH = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    rows = QUERIES[name](spark, PATH)
    got = sorted(map(tuple, rows.select(*sorted(rows.columns)).collect()))
    want = con.execute(f"SELECT {', '.join(sorted(rows.columns))} FROM ({ORACLES[name]})").fetchall()
    assert len(want) > 20 and got == sorted(want)


# phrases


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        for p in candidates:
            longer = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= 100 * f[p] for q in longer):
                continue
            score, _, left, right = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("entries", [phrases.TRIE_ENTRIES, 50])
def test_phrases(spark, monkeypatch, entries):
    rnd = random.Random(5)
    vocabulary = ["A", "b", "été", "d\x0be", "Z", "\xa0", "e\x00f"]
    texts = [None, "", " \t", "x. x, x", "A b" * 3]
    texts += ["".join(rnd.choice([" ", " ", "\t ", ". ", "\n", "!"]) + w for w in rnd.choices(vocabulary, [9, 6, 4, 2, 2, 1, 1], k=60)) for _ in range(60)]
    langs = [rnd.choice(["en", None, "fr", ""]) for _ in texts]
    docs = frame(spark, texts, lang=langs).repartition(4)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 900)
    totals, found = phrases.phrase_counts(docs, least=8, trie_entries=entries)
    assert found.where("f < 8").count() == 0 and totals.count() == 4
    got = sorted(map(tuple, phrases.collocations(docs, least=8, top=12).collect()))
    assert got == brute_phrases(list(zip(langs, texts, strict=True)), 8, 12) and len(got) > 20


def test_trie_bursts_and_spills():
    trie, want = phrases.HatTrie(container_entries=5), Counter()
    rnd = random.Random(2)
    for _ in range(3000):
        gram = [rnd.randrange(4) for _ in range(rnd.randint(1, 5))]
        key = b"".join(x.to_bytes(4, "big") for x in gram[1:])
        trie.add(gram[0], [key], [2])
        want[gram[0], key] += 2
    assert any(isinstance(node, phrases.HatTrie.Inner) for node in trie.root.values())
    assert len(trie) == len(want)
    got = {}
    for first in trie.largest(0):
        got.update({(first, key): f for key, f in trie.take(first)})
    assert got == want and len(trie) == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    n, a, left, right = 10**14, 9 * 10**12, 9 * 10**12 + 1, 9 * 10**12 + 7
    found = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, size int, phrase string, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (spark.createDataFrame([("en", n)], "lang string, n long"), found))
    assert phrases.collocations(None).collect()[0]["score"] == 1000 * a * n // (left * right)


# hard negatives


def brute_negatives(rows):
    taken = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        taken.append((vec_id, [floor(256 * c) for c in x], label))
    out = []
    for i, (anchor, q, label) in enumerate(taken):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, v, strict=True)), o, other) for j, (o, v, other) in enumerate(taken) if j != i and len(v) == len(q)]
        ranked = sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p in [s for s in ranked if s[2] == label][:5]:
            fit = [s for s in ranked if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(anchor, p[1], k, s[1], p[0], s[0]) for k, s in enumerate(fit[:5], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [hardneg.ROW_BLOCK, 400])
def test_hard_negatives(spark, monkeypatch, block):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.5, 0.625]) for _ in range(6)], rnd.choice([0, 0, 0, 1, 2, 9])) for i in range(0, 420)]
    rows += [(200, [0.5] * 6, 1), (3, [0.5] * 6, 1), (3, [0.5] * 6, 1), (None, [0.5] * 6, 2), (None, [0.5] * 6, 0)]  # ids that repeat, null ids
    rows += [(500, None, 1), (600, [0.5] * 6, None), (700, [None] + [0.5] * 5, 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [1.0] * 70, 1), (1101, [0.9] * 70, 1), (1102, [0.8] * 70, 0)]
    monkeypatch.setattr(hardneg, "ROW_BLOCK", block)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", block)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as row", "1 as part")
    got = Counter(map(tuple, hardneg.digest(table.repartition(3)).collect()))
    assert got == brute_negatives(rows) and sum(got.values()) > 50


def test_exact_scores_of_any_size():
    rng = np.random.default_rng(4)
    for largest, width in ((3, 5), (150, 64), (40_000, 130), (2**25, 64), (2**28, 2)):
        a, b = rng.integers(-largest, largest + 1, (7, width)), rng.integers(-largest, largest + 1, (9, width))
        a[0], b[0] = largest, -largest
        assert (hardneg.exact_scores(a, b) == a @ b.T).all()


def test_vectors_beyond_the_score_range_take_no_part(spark):
    rows = [(0, [1e9, 1.0], 1), (100, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [1.0, 0.8], 2), (3, [1e300, 1.0], 2)]
    got = hardneg.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [(r["anchor_id"], r["negative_id"]) for r in got] == [(100, 2)]


def test_no_vectors(spark):
    assert hardneg.digest(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# toxicity


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    path = PATH.replace("sf0.01", "sf0.1") if os.path.isdir(PATH.replace("sf0.01", "sf0.1")) else PATH
    docs, marks = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs, marks)
    assert out.count() == docs.count() and out.where("score between 0 and 1 and held_out is not null").count() == docs.count()
    rows = out.where("held_out").join(marks.where("toxic is not null"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.01
    for r in out.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_features_by_hand():
    owner, slot = toxicity.features(["A b, a b", None, "", "b"])
    assert owner.tolist().count(0) == 6  # a, b; a b, b a; a _ a, b _ b
    one, two = set(slot[owner == 0]), set(slot[owner == 3])
    assert two < one and not (owner == 1).any() and not (owner == 2).any()


def test_scores_are_those_of_a_plain_walk():
    rnd = random.Random(1)
    words = ["good", "fine", "scum", "tree", "idiot", "Straße"]
    texts = [" ".join(rnd.choices(words[:2] + words[3:4] + words[5:], k=12) + ([rnd.choice(["scum", "idiot"])] if i % 3 == 0 else [])) for i in range(600)]
    toxic = np.array([int(i % 3 == 0) for i in range(600)])
    model = toxicity.fit_ftrl([toxicity.features([t])[1] for t in texts], toxic)
    weight = dict(zip(model.slot.tolist(), model.weight.tolist(), strict=True))
    dense = model.dense()
    got = toxicity.scores(texts, model.bias, dense, dense != 0)
    for t, s in zip(texts, got, strict=True):
        total = model.bias + sum(weight.get(x, 0.0) for x in set(toxicity.features([t])[1].tolist()))
        assert s == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)
    assert ((got >= 0.7) == (toxic == 1)).mean() > 0.99
    assert 0 < len(model.slot) < 200


def test_one_label_gives_a_share():
    model = toxicity.fit_ftrl([np.array([1, 2])] * 8, np.ones(8, int))
    assert model.bias == pytest.approx(np.log(9)) and not len(model.slot)
    assert toxicity.fit_ftrl([], np.zeros(0, int)).bias == 0


@pytest.mark.parametrize("marks", [[(4, 0, 1), (8, 1, 0), (8, None, None), (None, 1, 1), (5, 1, 0)], []])
def test_awkward_rows_and_labels(spark, marks):
    docs = awkward(spark).withColumnRenamed("line", "_score")
    out = toxicity.digest(docs, labels(spark, marks)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    assert toxicity.digest(docs.where("false"), labels(spark, marks)).count() == 0
    assert phrases.digest(docs).count() >= 0 and phrases.digest(docs.where("false")).count() == 0
