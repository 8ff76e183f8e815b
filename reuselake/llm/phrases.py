"""Phrase collocations with exact counts from HAT-tries.

Each task counts the word sequences of its texts in a trie over word ids: shallow inner nodes, and hash containers that hold whole subtrees
below them. A container that grows too large bursts: it becomes an inner node whose children are containers of what follows.
When a task's trie holds more than ``TRIE_ENTRIES`` sequences, its largest subtrees are spilled as sorted runs, and at the end all that is left. Runs are
dealt by language and prefix (up to three words, so that the continuations of one frequent pair do not meet in one task) and
summed there.

A frequent phrase has frequent parts. So words are counted first, then pairs, then longer sequences, and each pass counts only what may still be
frequent by two kinds of bit tables of fixed size: exact counts of shorter parts, and a sketch that the pass before has made of
this size (hashed counters, which can only count too much). A bit that is set by chance costs
work, never a result. Nothing is sampled or cut, and only bit tables go through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reuselake.llm.common import empty_if_null, stored
from reuselake.llm.hashing import mix
from reuselake.llm.tokens import byte_kinds, chunks, split

LEAST, LONGEST, TOP = 100, 5, 2000
NO_LANGUAGE = "und"
#: Entries of a task's trie, and of one container, before they are spilled or burst.
TRIE_ENTRIES, CONTAINER_ENTRIES = 600_000, 20_000
#: Sizes of the table of frequent parts and of the sketch, and of the parts in which sketches travel.
BITS, SKETCH, SLICE = 1 << 24, 1 << 22, 1 << 16
CHUNK_BYTES = 2_000_000
BATCH_ROWS = 10_000
#: Fixed values of the definition: bytes between words, bytes that end a piece, and lower case of A-Z.
KINDS = byte_kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class HatTrie:
    """Counts of id sequences. A node is a container (dict of the remaining ids, 4 bytes each, to the count) or, once burst, a dict of nodes."""

    class Inner(dict):
        pass

    def __init__(self, container_entries: int = CONTAINER_ENTRIES):
        self.root: dict[int, dict] = {}
        self.entries: dict[int, int] = {}
        self.most = container_entries

    def add(self, first: int, keys: list[bytes], counts: list[int]) -> None:
        """Count sequences that begin with ``first``; ``keys`` are their other ids, big-endian."""
        top = self.root.setdefault(first, {})
        new = 0
        for key, count in zip(keys, counts, strict=True):
            node, parent, step = top, None, None
            while isinstance(node, HatTrie.Inner):
                parent, step, key = node, key[:4], key[4:]
                node = parent.setdefault(step, {})
            before = len(node)
            node[key] = node.get(key, 0) + count
            new += len(node) - before
            if len(node) > self.most and len(key) > 4:  # what is one id long has nothing below it
                burst = self._burst(node)
                if parent is None:
                    top = self.root[first] = burst
                else:
                    parent[step] = burst
        self.entries[first] = self.entries.get(first, 0) + new

    @staticmethod
    def _burst(container: dict[bytes, int]) -> HatTrie.Inner:
        inner = HatTrie.Inner()
        for key, count in container.items():
            inner.setdefault(key[:4], {})[key[4:]] = count
        return inner

    def __len__(self) -> int:
        return sum(self.entries.values())

    def largest(self, leave: int) -> list[int]:
        """First ids of the largest subtrees, so many that ``leave`` entries are left."""
        out, left = [], len(self)
        for first in sorted(self.entries, key=self.entries.get, reverse=True):
            if left <= leave:
                break
            out.append(first)
            left -= self.entries[first]
        return out

    def take(self, first: int) -> Iterator[tuple[bytes, int]]:
        """The sequences below ``first`` (without it) and their counts; the subtree is gone afterwards."""
        del self.entries[first]

        def below(node: dict, path: bytes) -> Iterator[tuple[bytes, int]]:
            for key, value in node.items():
                if isinstance(value, dict):
                    yield from below(value, path + key)
                else:
                    yield path + key, value

        yield from below(self.root.pop(first), b"")


def codes(lang: bytes, words: list[bytes]) -> np.ndarray:
    """A number for each word of a language, the same in every task."""
    head = zlib.crc32(lang + b"\0")
    return mix(np.array([zlib.crc32(w, head) for w in words], np.uint64) + np.uint64(1))


def slots(code: np.ndarray, at: np.ndarray, size: int, of: int) -> np.ndarray:
    """Places in a table of ``of`` entries of the ``size`` words that begin at ``at``."""
    value = code[at]
    for i in range(1, size):
        value = mix(value * np.uint64(3) + code[at + i])
    return (value & np.uint64(of - 1)).astype(np.int64)


def bit_table(parts: DataFrame) -> np.ndarray:
    """Bit table of rows (lang, phrase): at most ``BITS`` / 64 numbers reach the driver, whatever the number of parts."""
    @F.pandas_udf("long")
    def place(langs: pd.Series, phrases: pd.Series) -> pd.Series:
        out = []
        for lang, phrase in zip(langs, phrases, strict=True):
            words = phrase.encode().split(b" ")
            out.append(int(slots(codes(lang.encode(), words), np.zeros(1, np.int64), len(words), BITS)[0]))
        return pd.Series(out, dtype="int64")

    at = parts.select(place("lang", "phrase").alias("b"))
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    got = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("bits")).collect()
    table = np.zeros(BITS // 64, np.int64)
    for r in got:
        table[r["w"]] = r["bits"]
    return table.view(np.uint8)


def sketch_table(runs: DataFrame, least: int) -> np.ndarray:
    """Bit table of the sketches' slots whose counts reach ``least``: ``SKETCH`` bits reach the driver. Slices are summed as they come."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
                part[part == 255] = least  # a full counter may stand for any number
                sums[k] = np.minimum(sums.get(k, 0) + part, least)
        for k, total in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    parts = runs.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(merge, "slice int, bits binary")
    table = np.zeros(SKETCH // 8, np.uint8)
    for r in parts.collect():
        table[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return table


def _set(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return table[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


_RUN = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])


class _Counter:
    """A task's trie with its word ids. An id stands for a word of one language."""

    def __init__(self, trie_entries: int):
        self.trie, self.most = HatTrie(), trie_entries
        self.ids: dict[tuple[str, bytes], int] = {}
        self.words: list[tuple[str, bytes]] = []

    def number(self, lang: str, word: bytes) -> int:
        found = self.ids.get((lang, word))
        if found is None:
            found = self.ids[lang, word] = len(self.words)
            self.words.append((lang, word))
        return found

    def add_words(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first, count in zip(ids.tolist(), counts.tolist(), strict=True):
            self.trie.add(first, [b""], [count])
        yield from self.check()

    def add(self, grams: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        """Count rows of ids; yields runs when the trie is full."""
        grams = grams[np.lexsort(grams.T[::-1])]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]).any(1)
        at = np.nonzero(new)[0]
        counts, grams = np.diff(np.append(at, len(grams))), grams[at]
        firsts, begin = np.unique(grams[:, 0], return_index=True)
        ends = np.append(begin[1:], len(grams))
        width = 4 * (size - 1)
        packed = grams[:, 1:].astype(">u4").tobytes()
        total = counts.tolist()
        for first, b, e in zip(firsts.tolist(), begin.tolist(), ends.tolist(), strict=True):
            self.trie.add(first, [packed[i * width : (i + 1) * width] for i in range(b, e)], total[b:e])
        yield from self.check()

    def check(self) -> Iterator[pa.RecordBatch]:
        if len(self.trie) > self.most:
            yield from self.spill(self.most // 2)

    def spill(self, leave: int) -> Iterator[pa.RecordBatch]:
        """The largest subtrees, each as a sorted run; short runs share a batch."""
        rows: list[tuple[str, bytes, int, int]] = []
        for first in self.trie.largest(leave):
            lang, head = self.words[first]
            word = lambda key, i: self.words[int.from_bytes(key[i : i + 4], "big")][1]
            run = [(lang, b" ".join([head, *(word(key, i) for i in range(0, len(key), 4))]), 1 + len(key) // 4, f) for key, f in self.trie.take(first)]
            rows += sorted(run) if len(run) > 1 else run
            while len(rows) >= BATCH_ROWS:
                yield _batch(rows[:BATCH_ROWS])
                del rows[:BATCH_ROWS]
        if rows:
            yield _batch(rows)
        if not len(self.trie):
            self.ids, self.words = {}, []


def _batch(rows: list[tuple[str, bytes, int, int]]) -> pa.RecordBatch:
    lang, phrase, size, f = zip(*rows, strict=True)
    none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
    return pa.record_batch([pa.array(lang), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64()), *none], schema=_RUN)


class _Sketch:
    """Counts of hashed sequences in ``SKETCH`` slots; counters stop at 255."""

    def __init__(self):
        self.counts = np.zeros(SKETCH, np.uint8)

    def add(self, place: np.ndarray) -> None:
        used, more = np.unique(place, return_counts=True)
        self.counts[used] = np.minimum(self.counts[used] + more, 255)

    def slices(self) -> Iterator[pa.RecordBatch]:
        for k in range(SKETCH // SLICE):
            part = self.counts[k * SLICE : (k + 1) * SLICE]
            if part.any():
                none = [pa.nulls(1, f.type) for f in list(_RUN)[:4]]
                yield pa.record_batch([*none, pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=_RUN)


def _runs(rows: DataFrame, sizes: tuple[int, ...], sketched: int | None, words: np.ndarray | None = None, pairs: np.ndarray | None = None, triples: np.ndarray | None = None, trie_entries: int = TRIE_ENTRIES) -> DataFrame:
    """Runs (lang, size, phrase, f) of the sequences of ``sizes`` words within pieces whose words, pairs and triples have their bits set,
    and slices (slice, counts) of each task's sketch of such sequences of ``sketched`` words."""
    tables = rows.sparkSession.sparkContext.broadcast((words, pairs, triples))  # of fixed sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, pair_bits, triple_bits = tables.value
        counter, sketch = _Counter(trie_entries), _Sketch()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, mine in by_lang.items():
                for chunk in chunks([range(int(lengths[i])) for i in mine], CHUNK_BYTES):
                    part = split([texts[mine[i]].as_py() for i in chunk], KINDS, LOWER)
                    if not len(part.word):
                        continue
                    code = codes(lang.encode(), part.distinct)
                    good = np.ones(len(code), bool) if word_bits is None else _set(word_bits, slots(code, np.arange(len(code)), 1, BITS))
                    ids = np.array([counter.number(lang, w) if g else -1 for w, g in zip(part.distinct, good.tolist(), strict=True)], np.int64)
                    if 1 in sizes:
                        yield from counter.add_words(ids, np.bincount(part.word, minlength=len(ids)))
                    word, fit, of = ids[part.word], good[part.word], code[part.word]
                    at = part.windows(2, part.piece)
                    at = at[fit[at] & fit[at + 1]]
                    if pair_bits is not None:
                        at = at[_set(pair_bits, slots(of, at, 2, 8 * len(pair_bits)))]
                    if sketched == 2:
                        sketch.add(slots(of, at, 2, SKETCH))
                    linked = np.zeros(len(word) + 1, bool)  # a frequent pair, then a frequent triple, begins here
                    linked[at] = True
                    if 2 in sizes and len(at):
                        yield from counter.add(word[at[:, None] + np.arange(2)], 2)
                    if max(sizes) < 3 and sketched != 3:
                        continue
                    at = at[linked[at + 1]]
                    if triple_bits is not None:
                        at = at[_set(triple_bits, slots(of, at, 3, SKETCH))]
                    if sketched == 3:
                        sketch.add(slots(of, at, 3, SKETCH))
                    linked = np.zeros(len(word) + LONGEST, bool)
                    linked[at] = True
                    for size in range(3, max(sizes) + 1):
                        if size > 3:  # the last triple of the window
                            at = at[linked[at + size - 3]]
                        if size in sizes and len(at):
                            yield from counter.add(word[at[:, None] + np.arange(size)], size)
        yield from counter.spill(0)
        yield from sketch.slices()

    return stored(rows.mapInArrow(count, "lang string, size int, phrase string, f long, slice int, counts binary"), "runs")


def _summed(runs: DataFrame) -> DataFrame:
    head = F.substring_index("phrase", " ", 3)
    whole = runs.where("slice is null").select("lang", "size", "phrase", "f").repartition("lang", head)
    return whole.groupBy("lang", head.alias("_head"), "size", "phrase").agg(F.sum("f").alias("f")).drop("_head")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, trie_entries: int = TRIE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences of each language; (lang, size, phrase, f): every phrase of up to ``longest`` (5 at most) words with ``f`` >= ``least``."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), empty_if_null(F.col("text").cast("string")).alias("text"))
    one = _runs(rows, (1,), 2, trie_entries=trie_entries)
    words = stored(_summed(one), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = words.where(F.col("f") >= least)
    if longest >= 2:
        word_bits = bit_table(found)
        two = _runs(rows, (2,), 3 if longest > 2 else None, word_bits, sketch_table(one, least), trie_entries=trie_entries)
        pairs = stored(_summed(two).where(F.col("f") >= least), "pairs")
        if longest >= 3:
            more = _runs(rows, tuple(range(3, longest + 1)), None, word_bits, bit_table(pairs), sketch_table(two, least), trie_entries)
            pairs = pairs.unionByName(stored(_summed(more).where(F.col("f") >= least), "longer"))
        found = found.unionByName(pairs)
    return totals, found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null text counts as empty, a null language as ``und``. Equal scores are ordered by a, then by phrase (bytes). Rows that repeat a document count again.
    """
    totals, found = phrase_counts(docs, least, longest)
    long_ones = found.where("size >= 2")
    cuts = long_ones.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # exact: counts below 10**17, products as decimals of 38 digits
    wide = lambda x, y: f"cast({x} as decimal(17, 0)) * cast({y} as decimal(17, 0))"
    score = F.expr(f"cast(1000 * ({wide('a', 'n')}) as decimal(38, 0)) div cast({wide('l', 'r')} as decimal(38, 0))")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    sub = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), s -> concat_ws(' ', slice(split(phrase, ' '), s + 1, m)))))")
    inside = long_ones.where("size >= 3").select("lang", F.explode(sub).alias("phrase"), F.col("f").alias("within"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where("within is null or 100 * within < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang HAVING sum(len(ws)) > 0
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
  FROM lists, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, n, j, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS ws FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(ws, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(ws, j + 1, c.k), ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM lowest q WHERE NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = q.lang AND b.k > q.k AND 100 * b.f >= 100 * q.a AND contains(' ' || b.phrase || ' ', ' ' || q.phrase || ' '))
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER w <= 2000
"""
