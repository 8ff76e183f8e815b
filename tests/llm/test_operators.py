"""Operators against brute force on small fixtures, and their defined results for awkward rows."""

import datetime as dt
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reuselake.llm import bpe, dartminhash, decontam, hashing, langid, linededup, pii, quality, rules, sharding, suffix

PATH = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(PATH), reason="test tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, line string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None, source=None, lang=None):
    """Documents with extra columns whose names clash with those that operators make."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang[k] if lang else "en", source[k] if source else "s", 1, "x", "y", 0.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "same text here", "same text here", "same text here", "?!", long, long + " end", "x\n\nx\nx"]
    ids = [1, 2, 3, 4, 5, 5, 6, None, 8, 9, None]
    return frame(spark, texts, ids, source=[None, "s"] + ["t"] * 9, lang=[None] * 4 + ["en"] * 7)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ALL = {
    "langid": lambda s, d: langid.digest(d),
    "decontam": lambda s, d: decontam.digest(d, items(s, [(1, "same text here for you"), (None, "x"), (2, None), (2, "")])),
    "suffix": lambda s, d: suffix.digest(d),
    "darts": lambda s, d: dartminhash.digest(d),
    "keep_one": lambda s, d: dartminhash.keep_one(d),
    "lines": lambda s, d: linededup.digest(d),
    "cut_lines": lambda s, d: linededup.without_repeated_lines(d),
    "pii": lambda s, d: pii.digest(d, "k"),
    "bpe": lambda s, d: bpe.digest(d),
    "shards": lambda s, d: sharding.digest(d),
    "rules": lambda s, d: rules.digest(d, labels(s, [(4, 0, 0), (8, 1, 0), (8, None, 0), (None, 1, 1)])),
    "quality": lambda s, d: quality.digest(d, labels(s, [(4, 0, 0), (8, 1, 0), (5, 1, 0)])),
}
PER_ROW = {"langid", "suffix", "darts", "lines", "pii", "bpe", "shards", "rules", "quality"}


@pytest.mark.parametrize("name", sorted(ALL))
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    out = ALL[name](spark, docs).collect()
    if name in PER_ROW:
        assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(spark, name):
    assert ALL[name](spark, frame(spark, ["a"]).where("false")).count() == 0


def test_shards_hold_the_law(spark):
    rnd = random.Random(3)
    sources = ["hot"] * 400 + [rnd.choice("abc") for _ in range(300)] + [None] * 40 + ["rare"]
    docs = frame(spark, [None if i % 50 == 0 else "é" * (i % 9) for i in range(len(sources))], source=sources)
    out = sharding.digest(docs).collect()
    per = Counter(r["shard"] for r in out)
    assert sorted(per) == list(range(16)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    for source, n in Counter(sources).items():  # every shard matches the mixture
        share = Counter(r["shard"] for r in out if r["source"] == source)
        assert all(abs(share[s] - n / 16) <= 2 for s in range(16))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.digest(docs.repartition(7)).collect()}


def test_write_shards(spark, tmp_path):
    docs = frame(spark, [f"t{i}" for i in range(40)])
    sharding.write_shards(docs, sharding.shard_plan(docs, shards=4), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().where("count = 10").count() == 4


def base(text):
    text = text or ""
    words = WORD.findall(text)
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if three[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


@needs_tables
def test_rules_base_and_verdict(spark):
    docs, marks = (spark.read.parquet(f"{PATH}/{t}.parquet") for t in ("documents", "labels"))
    extra = frame(spark, [None, "", "a b a b a b a", "x\xa0y\x85z é\x0bw", "l\nl\n\n l\nl"], ids=[-1, -2, -3, -4, -5])
    docs = docs.unionByName(extra.select(*docs.columns))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for r in rules.digest(docs, marks).collect():
        kept[r["doc_id"]] = r["kept"]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    good = [kept[r["doc_id"]] for r in marks.where("quality = 1").collect() if not base(texts[r["doc_id"]])[-1]]
    bad = [kept[r["doc_id"]] for r in marks.where("quality = 0").collect()]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_rules_are_pruned_and_ordered():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.1) & (x[:, 2] > 0.5))
    found = rules.learn_rules(["a", "b", "c"], x, bad, np.arange(3000) % 3)
    hit = np.zeros(3000, bool)
    for r in found:
        assert len(r) <= 3
        hit |= rules._covers(r, ["a", "b", "c"], x)
    assert (hit == bad).mean() > 0.97 and rules.learn_rules(["a"], x[:0, :1], bad[:0], np.zeros(0)) == []


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"{PATH}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in quality.digest(docs, marks).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in out.items())
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in marks.collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_trees_fit_a_step():
    rng = np.random.default_rng(2)
    x = rng.random((800, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit_trees(x, y).score(x) > 0.5) == y).mean() > 0.97
    assert quality.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


@needs_tables
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    out = langid.digest(docs).collect()
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in out if r["held_out"] and len(truth[r["doc_id"]][1]) > 100]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)


def test_language_backs_off():
    words = {"der": np.array([-1.0, -9.0])}
    grams = {"sch": np.array([-2.0, -8.0]), "e": np.array([-5.0, -4.0]), "th": np.array([-9.0, -1.0])}
    model = langid.Model(["de", "en"], words, grams)
    assert model.word("der").tolist() == [-1, -9] and model.word("mensch").tolist() == [-2, -8]
    assert model.word("xth").tolist() == [-9, -1] and model.word("eq").tolist() == [-5, -4] and model.word("zz").tolist() == [0, 0]
    import pandas as pd
    out = next(langid.predict(model, iter([pd.Series(["Der Mensch", "12 !", None, "", "xth " * 70_000])])))
    assert out["lang_pred"].tolist() == ["de", "und", "und", "und", "en"] and out["score"].between(0, 1).all()


def repeats(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        yield len(t), sum(hit), runs, hashlib.sha256(bytes(c for c, h in zip(t, hit, strict=True) if not h)).hexdigest()


def thue_morse(n):
    """A sequence and its complement, whose sums modulo 2**64 agree for every seed from 1024 letters on."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [40, 129, 1024, 4096])
def test_spans_of_any_length_differ(n):
    one, two = thue_morse(n)
    hashes, starts = hashing.words_of([f"{one} {two} {one}".encode(), b"", one.encode()])
    assert hashes[0] == hashes[2] == hashes[3] != hashes[1] and starts.tolist() == [0, 3, 3, 4]
    rolling = hashing.PrimeRolling(np.frombuffer((one + two + one).encode(), np.uint8))
    found = rolling.spans(np.arange(3) * n, np.arange(1, 4) * n)
    assert found[0] == found[2] != found[1]
    every = rolling.windows(n)
    assert len(every) == 2 * n + 1 and (every[[0, n, 2 * n]] == found).all()
    alone = hashing.PrimeRolling(np.frombuffer(two.encode(), np.uint8)).windows(n)
    assert alone.tolist() == [found[1]]  # the same in any sequence
    assert len(hashing.PrimeRolling(np.zeros(0, np.uint8)).windows(3)) == 0


@pytest.mark.parametrize("key_bytes", [suffix.KEY_BYTES, 0])
def test_long_repeats_of_colliding_passages(spark, key_bytes):
    one, two = thue_morse(1024)
    texts = ["x" + one, two + "y", "z" + one + "z", "q" * 30 + two[:700]]
    out = {r["doc_id"]: r for r in suffix.without_repeats(frame(spark, texts), 900, 128, key_bytes).collect()}
    for i, want in enumerate(repeats([t.encode() for t in texts], 900)):
        r = out[i]
        assert (len(r["bytes"]), len(r["bytes"]) - len(r["kept"]), len(r["runs"] or []) // 2, hashlib.sha256(r["kept"]).hexdigest()) == want


def test_users_columns_stay(spark):
    """Names that the operators use for their own columns keep the user's values."""
    names = ["_kept", "_rule", "_stats", "_base_failed", "_leaks", "_node", "_removed", "_version", "_id", "_of", "aside0", "pos", "line", "place", "id", "other"]
    texts = [" ".join(f"word{i * 100 + k}" for k in range(60)) for i in range(4)]
    docs = frame(spark, [*texts, texts[0]]).selectExpr("doc_id", "text", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    bench = spark.createDataFrame([(1, texts[1])], "item_id long, text string")
    for out, ids in (
        (rules.kept(docs, []), {0, 1, 2, 3, 4}), (decontam.without_leaks(docs, bench), {0, 2, 3, 4}),
        (dartminhash.keep_one(docs), {0, 1, 2, 3}), (linededup.without_repeated_lines(docs), {0, 1, 2, 3}),
    ):
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


@pytest.mark.parametrize("key_bytes", [suffix.KEY_BYTES, 0])
def test_long_repeats(spark, key_bytes):
    """``key_bytes`` 0 sends every key to the exact window counts."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdé ") for _ in range(60))
    texts = [None, "", "ab" * 40, "a" * 50, passage, "x" + passage[:25] + "y", passage * 2, passage, "".join(rnd.choice("ab") for _ in range(300))]
    texts += [passage[rnd.randint(0, 20) : rnd.randint(25, 60)] + str(i) for i in range(30)]
    docs = frame(spark, texts)
    out = {r["doc_id"]: r for r in suffix.without_repeats(docs, 20, 8, key_bytes).collect()}
    for i, want in enumerate(repeats([(t or "").encode() for t in texts], 20)):
        r = out[i]
        runs = r["runs"] or []
        assert (len(r["bytes"]), len(r["bytes"]) - len(r["kept"]), len(runs) // 2, hashlib.sha256(r["kept"]).hexdigest()) == want


def test_run_index_counts_runs():
    index = suffix.RunIndex.build([b"abcabcabcabcabcabc", b"zzzzzzzz"])
    assert len(index.head) < 14 and index.matches(3)[0] == 15


def jaccard(a, b):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) for w in (a.split(), b.split()))
    return sum((a & b).values()) / sum((a | b).values())


def test_near_duplicates(spark):
    rnd = random.Random(5)
    texts = [None, "", "one two", "one  two", "three words only"]
    for f in range(12):
        first = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(6, 150))]
        texts.append(" ".join(first))
        for _ in range(rnd.randint(1, 8)):
            copy = list(first)
            for _ in range(rnd.randint(0, max(1, len(copy) // 40))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randint(0, 99)}"
            texts.append(" ".join(copy))
    out = {r["doc_id"]: r["class_id"] for r in dartminhash.digest(frame(spark, texts)).collect()}
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    words = [i for i, t in enumerate(texts) if t and t.split()]
    for i, j in itertools.combinations(words, 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert out == {i: root(i) for i in range(len(texts))}
    kept = {r["doc_id"] for r in dartminhash.keep_one(frame(spark, texts)).collect()}
    assert kept == {root(i) for i in range(len(texts))}


def test_darts_agree_with_the_weighted_similarity():
    owner = np.repeat([0, 1], 600)
    element = np.concatenate([np.arange(600), np.arange(200, 800)]).astype(np.uint64)
    for one, two in ((1.0, 1.0), (1.0, 2.0), (0.3, 0.5)):
        weight = np.repeat([one, two], 600)
        s = dartminhash.dart_signatures(owner, element, weight, 2, 3000)
        want = 400 * min(one, two) / (200 * one + 200 * two + 400 * max(one, two))
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_join(spark):
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(18, 40))) for _ in range(25)]
    for x in lines[:20]:
        for _ in range(3):
            y = list(x)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(y))
                y[k : k + 1] = rnd.choice([[], ["z"], [y[k], "q"]])
            lines.append("".join(y))
    lines += ["short", "shorz", "short", "", " "]
    rnd.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)] + [None]
    out = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in linededup.digest(frame(spark, texts)).collect()}
    seen, kept = [], {}
    for d, t in enumerate(texts):
        gone, parts = [], (t or "").split("\n")
        for k, x in enumerate(parts):
            if WORD.search(x):
                if any(x == y or min(len(x), len(y)) >= linededup.MIN_CHARS and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in seen):
                    gone.append(k)
                seen.append(x)
        n = sum(1 for x in parts if WORD.search(x))
        assert out[d] == (n, gone)
        if not gone or n > len(gone):
            kept[d] = t if t is None else "\n".join(x for k, x in enumerate(parts) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(frame(spark, texts)).collect()} == kept


@pytest.mark.parametrize("most", [0, 2, 1000])
def test_crowded_lines(spark, most):
    rnd = random.Random(8)
    base = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(14)]
    lines = {" ".join(base)}
    while len(lines) < 90:  # near copies of one line, some of them within two edits of each other
        words = list(base)
        for _ in range(rnd.randint(1, 2)):
            words[rnd.randrange(14)] = rnd.choice(["zeta", "omega", "theta"])
        text = " ".join(words)
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice(["", "z", text[k] + "q"]) + text[k + 1 :]
        lines.add(text)
    lines = sorted(lines | {x[1:-1] for x in list(lines)[:10]} | {"tiny", "tin"})
    rnd.shuffle(lines)
    rows = spark.createDataFrame([(i, x, i << 32, 1) for i, x in enumerate(lines)], "id long, line string, place long, times long")
    found = {r["id"] for r in linededup.repeated(rows.withColumn("place", rows.place.cast("decimal(38,0)")), min_chars=3, most=most).collect()}
    assert found == {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in lines[:i])}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    days = [dt.date(1990, 1, 1) + dt.timedelta(37 * i) for i in range(300)]
    docs = frame(spark, [
        "a 4111 1111 1111 1111 b 4111111111111111", "no 9807915762804490 nor 4111111111111112", "at 97.51.17.173, not 999.1.1.1 or 1.2.3.4.5",
        "born 2024-02-29 not 2023-02-29", "+1 (017) 555-7713 and 123-45-6789 but 000-45-6789", 'token = "747e8edd6430861f24c6911d38d6f174e76a63b3" x@y.example.com', None, "plain",
        " ".join(map(str, days)),
    ])
    out = {r["doc_id"]: r for r in pii.digest(docs, "k").collect()}
    cards = re.findall(r"\d[\d ]{13,}\d", out[0]["text"])
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] != "4111111111111111" and all(map(luhn, cards)) and re.fullmatch(r"\d{4}( \d{4}){3}", cards[0])
    assert out[1]["text"] == "no 9807915762804490 nor 4111111111111112" and out[1]["n_card"] == 0
    ip = re.match(r"at ([\d.]+), not 999.1.1.1 or 1.2.3.4.5$", out[2]["text"])[1]
    assert ip != "97.51.17.173" and all(int(x) < 256 for x in ip.split(".")) and out[2]["n_ip"] == 1
    assert "2023-02-29" in out[3]["text"] and out[3]["n_date"] == 1 and "2024-02-29" not in out[3]["text"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and 123-\d\d-\d{4} but 000-45-6789", out[4]["text"]) and "555-7713" not in out[4]["text"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" u[0-9a-f]{15}@example.com', out[5]["text"]) and "747e8edd" not in out[5]["text"]
    assert out[6]["text"] is None and out[7]["text"] == "plain"
    moved = out[8]["text"].split()
    assert len(set(moved)) == 300 and all(1800 <= dt.date.fromisoformat(x).year < 2200 for x in moved)
    other = {r["doc_id"]: r["text"] for r in pii.digest(docs, "other").collect()}
    assert other[0] != out[0]["text"] and other[1] == out[1]["text"]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    rows = spark.range(189 * 773).select(pii.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773), "k", "t").alias("x"))
    assert rows.where("x.a between 0 and 188 and x.b between 0 and 772").distinct().count() == 189 * 773


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    parts = list("aabst'lrevemd  \n.12_!É") + ["<|endoftext|>", "<|start", "'s", "'re", "é", "é", "Σ", "Ω", "İ", "한", "😀", "\x1c", "\xa0", "ß", "ﬁ", "ς "]
    texts = [None, "", "   ", "<|endoftext|>"] + ["".join(rnd.choice(parts if i % 3 else parts[:22]) for _ in range(rnd.randint(0, 60))) for i in range(600)]
    texts.append(" ".join(thue_morse(1024)))
    whole = Tokenizer.from_file(bpe.vocabulary())
    out = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["decoded"] == whole.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(frame(spark, texts))).where("text <> decoded").count()
    assert again == 0


def leaks(text, bench):
    words = decontam.WORD.findall((text or "").lower())
    out = set()
    for i, t in bench:
        item = decontam.WORD.findall(t.lower())
        row = [0] * (len(words) + 1)
        for k, x in enumerate(item, 1):
            last, row[0] = row[0], k
            for j, y in enumerate(words, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if len(item) >= decontam.LEAST_WORDS and min(row) <= decontam.allowed(len(item)):
            out.add((i, min(row)))
    return out


def test_decontamination(spark):
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else f"r{rnd.randint(0, 3000)}"
    bench = [(i, " ".join(word() for _ in range(rnd.randint(5, 60)))) for i in range(40)]
    texts = [None, ""]
    for k in range(300):
        body = [word() for _ in range(rnd.randint(0, 200))]
        if k % 2:
            item = bench[rnd.randrange(40)][1].split()
            for _ in range(rnd.randint(0, max(1, len(item) // 6))):
                at = rnd.randrange(len(item))
                item[at : at + 1] = rnd.choice([[], ["zz"], [item[at], "yy"]])
            at = rnd.randint(0, len(body))
            body[at:at] = [x.upper() + "!!" for x in item]
        texts.append(" ".join(body))
    out = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.digest(frame(spark, texts), items(spark, bench)).collect()}
    want = {(d, i): e for d, t in enumerate(texts) for i, e in leaks(t, bench)}
    assert set(out) <= set(want) and len(out) >= 0.95 * len(want) and len(want) > 100
    assert all(out[k] == want[k] for k in out if want[k] == 0)
    clean = {r["doc_id"] for r in decontam.without_leaks(frame(spark, texts), items(spark, bench)).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in out}


def test_short_items_and_scripts_without_blanks(spark):
    bench = [
        (1, "Solve x^2 = 4"), (2, "四加五等于多少"), (3, "ประเทศไทยมีกี่จังหวัด"), (4, "東京"), (5, "Paris"), (6, "?!"), (7, "solve X 2, 4"), (8, "x 2"),
    ]
    texts = [
        "Please solve: X^2 = 4 now", "solve x 2", "请问四加六等于多少呢", "ข้อสอบ ประเทศไทยมีกี่จังหวัด ตอบ", "私は東京都にいる", "東 and 京都", "comparison of parish", "in PARIS.", "4", "Solve x", "2 = 4",
        "四加六等於几何",
    ]
    out = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.digest(frame(spark, texts), items(spark, bench)).collect()}
    assert out == {(0, 1): 0, (0, 7): 0, (0, 8): 0, (1, 8): 0, (2, 2): 1, (3, 3): 0, (4, 4): 0, (7, 5): 0}
    assert decontam.WORD.findall("naïve_x2 日本ที่ ไป가나") == ["naïve", "x2", "日", "本", "ที่", "ไ", "ป", "가나"]
    left = {r["doc_id"] for r in decontam.without_leaks(frame(spark, texts), items(spark, bench)).collect()}
    assert left == {5, 6, 8, 9, 10, 11}


def test_long_items_with_edits_are_found(monkeypatch):
    rng = np.random.default_rng(3)
    say = lambda x: " ".join(f"w{k}" for k in x)
    bench = rng.integers(0, 4000, (2, 3000))
    texts, n = [], decontam.allowed(3000)
    for k in range(16):  # spread over the whole item, as many as are allowed
        edited = decontam._edited(bench[k % 2], n, 9000, rng)
        texts.append(say(np.concatenate([rng.integers(5000, 9000, 50), edited, rng.integers(5000, 9000, 50)])))
    texts.append(say(np.concatenate([bench[0][:2000], rng.integers(5000, 9000, 1000)])))
    found = decontam.find(decontam.fit_search([(k, say(b)) for k, b in enumerate(bench)]), texts)
    assert [[x["item_id"] for x in f] for f in found] == [[k % 2] for k in range(16)] + [[]]
    assert all(x["edits"] <= n for f in found for x in f)

    # no repetition reaches the target: the exact way
    monkeypatch.setattr(decontam, "MOST_REPETITIONS", 0)
    short = [(k, say(rng.integers(0, 200, 5 + 9 * k))) for k in range(10)]
    texts = [say(np.concatenate([rng.integers(100, 400, 30), decontam._edited(np.array([int(w[1:]) for w in t.split()]), decontam.allowed(5 + 9 * k), 400, rng), rng.integers(100, 400, 30)])) for k, t in short]
    found = decontam.find(decontam.fit_search(short), texts)
    assert [{(x["item_id"], x["edits"]) for x in f} for f in found] == [leaks(t, short) for t in texts]


def test_pseudonyms_in_other_forms(spark):
    given = [
        "4111 1111 1111 1111 12/26", "4111 1111 1111 1111 123", "order 7 4111111111111111", "4111 1111 1111 1111 2024-02-29", "5500-0000-0000-0004 4111 1111 1111 1111",
        "555-123-4567", "(555) 123-4567", "+44 20 7946 0958", "31.12.1999", "12/31/1999", "3 May 1990", "December 25, 2001", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "31.13.1999 DE88370400440532013000",
    ]
    forms = [
        r"(\d{4} \d{4} \d{4} \d{4}) 12/26", r"(\d{4} \d{4} \d{4} \d{4}) 123", r"order 7 (\d{16})", r"(\d{4} \d{4} \d{4} \d{4}) (?!2024-02-29)\d{4}-\d\d-\d\d", r"\d{4}-\d{4}-\d{4}-\d{4} (\d{4} \d{4} \d{4} \d{4})",
        r"\d{3}-\d{3}-\d{4}", r"\(\d{3}\) \d{3}-\d{4}", r"\+44 \d\d \d{4} \d{4}", r"\d\d\.\d\d\.\d{4}", r"\d\d/\d\d/\d{4}", r"\d{1,2} [A-Z][a-z]{2} \d{4}", r"[A-Z][a-z]+ \d\d, \d{4}", r"DE\d\d( \d{4}){4} \d\d", r"GB\d\dWEST\d{14}",
    ]
    rows = {r["doc_id"]: r for r in pii.digest(frame(spark, given), "k").collect()}
    for k, form in enumerate(forms):
        new = rows[k]["text"]
        assert re.fullmatch(form, new) and new != given[k], (given[k], new)
        if k < 5:
            assert luhn(re.fullmatch(form, new)[1].replace(" ", "")) and "4111 1111" not in new and rows[k]["n_card"] == (2 if k == 4 else 1)
    assert [rows[k]["n_phone"] for k in (5, 6, 7)] == [1] * 3 and [rows[k]["n_date"] for k in (3, 8, 9, 10, 11)] == [1] * 5 and rows[12]["n_iban"] == rows[13]["n_iban"] == 1
    for k in (12, 13):
        x = rows[k]["text"].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert rows[14]["text"] == given[14]


def test_rare_language_is_learnt(spark):
    texts = [f"hot{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} common words" for k in range(3000)] + [f"žluť{chr(97 + k)} kůň" for k in range(12)]
    docs = frame(spark, texts, lang=["aa"] * 3000 + ["cs"] * 12)
    model = langid.fit(docs, fit_docs=100, max_words=20, max_grams=20)
    learnt = [t.split()[0] for k, t in enumerate(texts) if k >= 3000 and zlib.crc32(str(k).encode()) % 5]
    assert model.langs == ["aa", "cs"] and learnt and set(learnt) <= set(model.words)
    told = {r["doc_id"]: r["_lang"]["lang_pred"] for r in langid.with_language(docs.where("doc_id >= 2900"), model).collect()}
    assert told == {k: "cs" if k >= 3000 else "aa" for k in range(2900, 3012)}


def test_line_keys_are_right_and_compiled(spark):
    from pyspark.sql import functions as F

    from reuselake.llm import linededup as L

    texts = ["a line of some twenty", "é" * 23 + "xyz", "abc", "x" * 50 + "y" * 41]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, line string").withColumn("n", F.length("line"))
    put, ask = L.indexed(lines, "id"), L.probes(lines)
    want_put, want_ask = set(), set()
    cut = lambda n, i: (i * (n // 3) + max(0, i - (3 - n % 3)), n // 3 + (i >= 3 - n % 3))
    for k, t in enumerate(texts):
        want_put |= {(k, len(t), i, t[cut(len(t), i)[0]:][:cut(len(t), i)[1]]) for i in range(3)}
        for less, i, shift in [(0, 0, 0), (0, 1, -1), (0, 1, 0), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 2, 1), (2, 0, 0), (2, 1, 1), (2, 2, 2)]:
            begin, size = cut(len(t) - less, i)
            if 0 <= begin + shift and begin + shift + size <= len(t):
                want_ask.add((k, len(t) - less, i, t[begin + shift:][:size]))
    for got, want, who in ((put, want_put, "id"), (ask, want_ask, "other")):
        keys = spark.createDataFrame(sorted(want), "k int, l int, i int, s string").select("k", F.xxhash64("l", "i", "s").alias("key"))
        assert {tuple(r) for r in got.select(who, "key").collect()} == {tuple(r) for r in keys.collect()}
        # the JVM compiles no method of over 8000 bytes
        parts = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(got._jdf.queryExecution().executedPlan())
        assert 0 < max(parts.apply(j)._3().maxMethodCodeSize() for j in range(parts.size())) < 8000
