"""Top k by descending floors, vector joins that skip blocks, and buckets that are split."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reuselake.operators import compare as C
from reuselake.operators import similarity as S


def contents(spark, rows):
    schema = "content string, bag array<string>, shingles array<string>, first_logical string, _rows long"
    df = spark.createDataFrame(rows, schema)
    return df.select("*", F.substring_index("content", ":", 1).alias("language"), F.lit(None).cast("array<double>").alias("_v"))


def share(x, y):
    return len(set(x) & set(y)) / max(1, len(set(x) | set(y)))


@pytest.mark.parametrize("least", [1, 4000])
def test_best_pairs_equal_brute_force(spark, least):
    rnd = random.Random(6)
    some = lambda n, m: [f"e{rnd.randrange(m)}" for _ in range(rnd.randrange(n))]
    make = lambda k: [(f"{rnd.choice(['sql', 'python'])}:{i}", sorted(set(some(8, 14))), sorted(set(some(12, 40))), f"c{i:03d}", rnd.choice([1, 1, 3])) for i in range(k)]
    q, c = make(40), make(60)
    got = {}
    for r in C.best_pairs(contents(spark, q), contents(spark, c), None, 3, least).collect():
        got.setdefault(r.left_id, []).append((-round(r.combined, 4), r.right_id))
    for name, bag, shingles, _, _ in q:
        every = []
        for other, bag2, shingles2, _, _ in c:
            feature = round(share(bag, bag2), 4)
            same = name.split(":")[0] == other.split(":")[0]
            score = round(0.8 * share(shingles, shingles2) + 0.2 * feature, 4) if same else feature
            if score * 10_000 >= least - 1e-6:
                every.append((-score, other))
        names = {other: first for other, _, _, first, _ in c}
        best = sorted(every, key=lambda x: (x[0], names[x[1]]))
        mine = sorted(got.get(name, []), key=lambda x: (x[0], names[x[1]]))
        # a query may be settled with fewer than k contents if their copies fill the places
        assert mine == best[: len(mine)]
        rows = {other: n for other, _, _, _, n in c}
        assert len(mine) == min(3, len(best)) or sum(rows[o] for _, o in mine) >= 3


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Clustered vectors: most block pairs are never multiplied, and the results are those of numpy."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    v = np.concatenate([c + 0.03 * rng.normal(size=(25, 24)) for c in centres] + [np.zeros((2, 24))])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    df = df.unionByName(spark.createDataFrame([(-1, None)], df.schema))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round((v / np.where(norm == 0, 1, norm)) @ (v / np.where(norm == 0, 1, norm)).T, 4)
    got = {}
    for r in S.embedding_topk(df, df, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.candidate_id, r.cosine))
    for i in range(len(v)):
        best = sorted((-cos[i, j], j) for j in range(len(v)) if j != i)[:4]
        assert [(n, s) for n, _, s in sorted(got[i])] == [(n, pytest.approx(-s, abs=1e-4)) for n, (s, _) in enumerate(best, 1)]
    pairs = {(r.a, r.b) for r in S.embedding_pairs(df, df, 0.9).collect()}
    assert pairs == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if cos[i, j] >= 0.9}
    work = S.pairs_work(df, df, 0.9).collect()[0]
    assert work.multiplied < work.block_pairs and work.skipped_share > 0.5
    assert S.embedding_topk(df.where("vec_id < 0"), df, 4).count() == 0 and S.embedding_topk(df, df.where("vec_id < 0"), 4).count() == 0


@pytest.mark.parametrize("threshold", [(4, 5), (1, 2)])
def test_split_buckets_lose_nothing(spark, monkeypatch, threshold):
    """A large family of near copies, buckets of three: every pair of the exact join is found."""
    monkeypatch.setattr(S, "BUCKET", 3)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    sets = [sorted(set(base) - set(rnd.sample(base, rnd.choice([1, 2, 4]))) | {f"x{rnd.randrange(60)}"}) for _ in range(60)]
    sets += [[f"y{rnd.randrange(30)}" for _ in range(9)] for _ in range(30)] + [[], sets[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, elements array<string>").withColumn("elements", F.array_distinct("elements"))
    report = S.near_duplicates_recall(df, threshold=threshold).collect()[0]
    assert report.pairs > 100 and report.found == report.pairs and report.recall == 1


def test_bands_follow_the_threshold():
    for t in (0.3, 0.5, 0.8, 0.95):
        bands, rows = S.bands_for(t)
        assert bands * rows <= 192 and ((1 - t**rows) ** bands <= S.MISSED or rows == 1)
        assert (1 - t) ** S.split_rounds(t) <= S.MISSED


def test_tiles_keep_ties_and_repeated_ids(spark, monkeypatch):
    """Equal vectors, a repeated id, many tiles: the ranks are those of numpy, and only the first blocks meet pair by pair."""
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "TILE", 2)
    monkeypatch.setattr(S, "FEW", 40)
    rng = np.random.default_rng(8)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 12)), 70, 0), rng.normal(size=(90, 12)), np.zeros((3, 12))])
    ids = [*range(len(v) - 1), 100]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "vec_id long, embedding array<double>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round((v / np.where(norm == 0, 1, norm)) @ (v / np.where(norm == 0, 1, norm)).T, 4)
    got = {}
    for r in S.embedding_topk(df, df, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.candidate_id, r.cosine))
    for i in range(len(v)):
        if ids[i] != 100:
            best = sorted((-cos[i, j], ids[j]) for j in range(len(v)) if ids[j] != ids[i])[:6]
            assert sorted(got[ids[i]]) == [(n, j, pytest.approx(-s, abs=1e-9)) for n, (s, j) in enumerate(best, 1)]
    pairs = {(r.a, r.b) for r in S.embedding_pairs(df, df, 0.5).collect()}
    assert pairs == {(min(x, y), max(x, y)) for i, x in enumerate(ids) for j, y in enumerate(ids) if x != y and cos[i, j] >= 0.5}


def test_a_block_is_sent_once_to_a_tile(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)], "vec_id long, embedding array<double>")
    c = S.stored(S.vector_groups(df, S.vector_pivots(df)))
    pairs = S.stored(S.block_pairs(c, c, S.vector_pivots(df)).select("q_pivot", "q_part", "c_pivot", "c_part"))
    sent = S._tiles(pairs, c, c).select("tile", "key", F.size("wanted").alias("n")).collect()
    assert sum(r.n for r in sent if r.n is not None and r.n > 0) == pairs.count() > 2 * len(sent)
    assert len({(r.tile, r.key, r.n is None or r.n < 0) for r in sent}) == len(sent)
