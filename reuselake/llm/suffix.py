"""Removal of long repeats with a run-length compressed index (run-compressed Burrows-Wheeler transform, sampled run ends).

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes. The corpus is far too large for one index, so equal
strings are first brought together: consecutive windows of ``length`` bytes with the same smallest hash of their ``anchor``-byte substrings
form a passage, and equal windows have the same smallest hash, so their passages have the same key. Only keys that occur again are
followed up, and each distinct passage is indexed once with its count: copies cost nothing.

A block of passages gets a suffix array and from it the run-length index: symbols and heads of the runs of the Burrows-Wheeler
transform, and the text places of each run's first and last suffix. A suffix inside a run agrees with its neighbour in the
symbol before, so its match is the previous place's less one: matches are computed at the sampled run ends only and
streamed along the text in between (the permuted LCP rule). That gives for each place the longest match that starts elsewhere.

Keys whose distinct passages outgrow a block (one short passage in a large part of all texts) are split by the hash of each whole window instead,
which counts them exactly. No task gets an unbounded group and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import empty_if_null, stored
from reuselake.llm.hashing import PrimeRolling, Rolling, digest_64

LENGTH = 400
ANCHOR = 128
#: Windows of a passage at most; a longer stretch with one key is cut.
WINDOWS = 1024
#: Bytes of passages in one index, and of one key's distinct passages that may be indexed together.
BLOCK_BYTES = 1_000_000
KEY_BYTES = 3_000_000
#: Bytes whose windows are hashed together.
PIECE_BYTES = 2_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, x
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[: len(x) - width + 1], low[width - span :][: len(x) - width + 1])


def passages(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: (text number, start, windows, key, content hash, twice) of their passages; shorter texts have none.

    ``twice``: the key's substring stands at two places of the passage, so that the passage may repeat a window by itself.
    """
    step = PIECE_BYTES
    cuts = [(i, at) for i, t in enumerate(texts) for at in range(0, max(len(t) - length + 1, 0), step)]
    group: list[tuple[int, int]] = []
    size = 0
    for i, at in [*cuts, (-1, 0)]:
        if group and (i < 0 or size >= step):
            yield _cut(texts, group, length, anchor)
            group, size = [], 0
        if i >= 0:
            group.append((i, at))
            size += min(len(texts[i]) - at, step + length - 1)


def _cut(texts, group, length, anchor):
    parts = [texts[i][at : at + PIECE_BYTES + length - 1] for i, at in group]
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    joined = b"".join(parts)
    hashes = Rolling(np.frombuffer(joined, np.uint8)).windows(anchor)
    key = _sliding_min(hashes, length - anchor + 1)
    windows = sizes - length + 1
    first = np.zeros(len(key) + 1, bool)
    first[1:-1] = key[1:] != key[:-1]
    first[begin] = True
    ends = begin + windows
    first[ends] = True
    start = np.nonzero(first)[0]
    stop = np.append(start[1:], len(key))
    own = np.searchsorted(begin, start, "right") - 1
    real = start < ends[own]
    start, stop, own = start[real], stop[real], own[real]
    pieces = -(-(stop - start) // WINDOWS)
    row = np.repeat(np.arange(len(start)), pieces)
    start = start[row] + WINDOWS * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(stop[row] - start, WINDOWS)
    own = own[row]
    which = np.array([i for i, _ in group])[own]
    offset = start - begin[own] + np.array([at for _, at in group])[own]
    until = start + count + length - 1
    content = np.fromiter((digest_64(joined[a:b]) for a, b in zip(start.tolist(), until.tolist(), strict=True)), np.uint64, len(start))
    return which, offset, count, key[start], content, _places(hashes, key[start], start, start + count + length - anchor) > 1


def _places(hashes: np.ndarray, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each ``value`` stands among the hashes from ``begin`` to before ``end``."""
    known, number = np.unique(value, return_inverse=True)
    low = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[known & low] = True
    place = np.nonzero(maybe[hashes & low])[0]
    k = np.minimum(np.searchsorted(known, hashes[place]), max(len(known) - 1, 0))
    real = known[k] == hashes[place] if len(known) else np.zeros(0, bool)
    n = len(hashes) + 1
    at = np.sort(k[real] * n + place[real])
    return np.searchsorted(at, number * n + end) - np.searchsorted(at, number * n + begin)


@dataclass
class RunIndex:
    """Run-length index of separated texts: per run its symbol, head (place in the transform) and the text places of its ends."""

    symbols: np.ndarray  # of the text, separators are unique
    symbol: np.ndarray
    head: np.ndarray
    first: np.ndarray  # text place of the run's first suffix
    last: np.ndarray  # ... and last
    before: np.ndarray  # text place of the suffix before the first, -1 without
    after: np.ndarray  # ... and after the last

    @classmethod
    def build(cls, texts: list[bytes]) -> RunIndex:
        sizes = np.array([len(t) for t in texts])
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        symbols = joined.astype(np.int64) + 1
        stops = np.cumsum(sizes + 1) - 1
        symbols[stops] = 257 + np.arange(len(texts))
        order = suffix_order(symbols, stops)
        previous = symbols[order - 1]  # before the first place stands the last separator
        new = np.ones(len(order), bool)
        new[1:] = previous[1:] != previous[:-1]
        head = np.nonzero(new)[0]
        tail = np.append(head[1:], len(order)) - 1
        padded = np.concatenate([[-1], order, [-1]])
        return cls(symbols, previous[head], head, order[head], order[tail], padded[head], padded[tail + 2])

    def matches(self, least: int) -> np.ndarray:
        """For every place the longest match with another place, exact from ``least`` on and otherwise anything below it.

        A sample whose match is shorter stays below ``least`` as it is streamed on, so only the others are measured.
        """
        rolling = PrimeRolling(self.symbols, seed=3)
        out = np.zeros(len(self.symbols), np.int64)
        places = np.arange(len(out))
        for sample, neighbour in ((self.first, self.before), (self.last, self.after)):
            known = np.full(len(out), -1)
            known[sample] = 0
            long = np.nonzero((neighbour >= 0) & (np.maximum(sample, neighbour) + least <= len(out)))[0]
            x, y = sample[long], neighbour[long]
            long = long[rolling.spans(x, x + least) == rolling.spans(y, y + least)]
            known[sample[long]] = common_prefix(rolling, sample[long], neighbour[long], least)
            base = np.maximum.accumulate(np.where(known >= 0, places, 0))
            out = np.maximum(out, known[base] - (places - base))
        return out


def common_prefix(rolling: PrimeRolling, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Longest common prefix, known to be ``least`` or more, of the suffixes at ``a`` and ``b`` by doubling and halving on hashes."""
    low, room = np.full(len(a), least, np.int64), rolling.n - np.maximum(a, b)
    high, step = low.copy(), 1
    grow = np.arange(len(a))
    while len(grow):
        high[grow] = np.minimum(low[grow] + step, room[grow])
        x, y, n = a[grow], b[grow], high[grow]
        same = (rolling.spans(x, x + n) == rolling.spans(y, y + n)) & (n > low[grow])
        low[grow[same]] = n[same]
        grow = grow[same]
        step *= 2
    high = np.maximum(high - 1, low)
    while True:
        open_ = np.nonzero(low < high)[0]
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = rolling.spans(x, x + middle) == rolling.spans(y, y + middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)


def suffix_order(symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling on those not yet told apart; separators (at ``stops``) are unique."""
    n, width = len(symbols), 7
    plain = np.where(symbols > 256, 0, symbols)
    padded = np.append(plain, np.zeros(width, np.int64))
    key, live, cut = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
    for j in range(width):
        at = padded[j : j + n]
        key = key << 9 | np.where(live, at, 0)
        live &= at > 0
    cut = ~live  # a separator stands within the first ``width``: its text number tells the suffix from its likes
    rank = _dense(key)
    rank = _dense(rank * (len(stops) + 1) + np.where(cut, np.searchsorted(stops, np.arange(n)) + 1, 0))
    # from dense ranks to first places of groups
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]
    group = np.bincount(rank, minlength=n)
    open_ = np.nonzero(group[rank] > 1)[0]
    step = width
    while len(open_):
        second = rank[np.minimum(open_ + step, n - 1)]
        pair = rank[open_] * (n + 1) + second
        order = np.argsort(pair)
        open_, pair = open_[order], pair[order]
        old = rank[open_]
        at = np.arange(len(open_))
        new_pair = np.ones(len(open_), bool)
        new_pair[1:] = pair[1:] != pair[:-1]
        new_old = np.ones(len(open_), bool)
        new_old[1:] = old[1:] != old[:-1]
        start = np.maximum.accumulate(np.where(new_pair, at, 0))
        rank[open_] = old + start - np.maximum.accumulate(np.where(new_old, at, 0))
        alone = new_pair & np.append(new_pair[1:], True)
        open_ = open_[~alone]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def covered(texts: list[bytes], more: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct text the runs (from, to, from, to, ...) of bytes in strings of ``length`` that start elsewhere too.

    ``more``: the text itself occurs more than once.
    """
    if not texts:
        return []
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    change = np.zeros(int(sizes.sum()) + 1, np.int64)
    hit = np.nonzero(RunIndex.build(texts).matches(length) >= length)[0]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + length, -1)
    whole = np.nonzero(np.array(more, bool) & (sizes > length))[0]  # every window of a copied text starts in its copy too
    np.add.at(change, begin[whole], 1)
    np.add.at(change, begin[whole] + sizes[whole] - 1, -1)
    inside = np.cumsum(change) > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    own = np.searchsorted(begin, start, "right") - 1
    pairs = np.stack([start - begin[own], stop - begin[own]], 1).astype(np.int32)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1))
    return [pairs[cuts[i] : cuts[i + 1]].reshape(-1) for i in range(len(texts))]


# --- Spark ---

_OCCURRENCES = "d long, t long, start int, windows int, v long, c long, twice boolean"
_SPANS = "v long, c long, spans array<int>"


def _occurrences(length: int, anchor: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            for which, start, count, key, content, twice in passages(b.column(2).to_pylist(), length, anchor):
                yield pa.record_batch({
                    "d": d[which], "t": t[which], "start": start.astype(np.int32), "windows": count.astype(np.int32), "v": key.view(np.int64), "c": content.view(np.int64), "twice": twice,
                })
    return cut


def _indexed(length: int):
    """Rows (v, c, more, passage) sorted by v: whole keys are gathered up to a block, then indexed."""
    def run(rows: dict) -> pa.RecordBatch:
        keys = list(rows)
        spans = covered([rows[k][0] for k in keys], [rows[k][1] for k in keys], length)
        some = [i for i, s in enumerate(spans) if len(s)]
        return pa.record_batch({
            "v": pa.array([keys[i][0] for i in some], pa.int64()), "c": pa.array([keys[i][1] for i in some], pa.int64()),
            "spans": pa.array([spans[i] for i in some], pa.list_(pa.int32())),
        })

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {}
        size, last = 0, None
        for b in batches:
            for v, c, more, text in zip(*(b.column(x).to_pylist() for x in ("v", "c", "more", "passage")), strict=True):
                if size >= BLOCK_BYTES and v != last:
                    yield run(rows)
                    rows, size = {}, 0
                last = v
                if (v, c) not in rows:
                    rows[v, c] = (text, more)
                    size += len(text)
        if rows:
            yield run(rows)
    return index


def _windows(length: int):
    """(v, c, offset, two hashes) of every window of a passage."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, c, times, text in zip(*(b.column(x).to_pylist() for x in ("v", "c", "times", "passage")), strict=True):
                symbols = np.frombuffer(text, np.uint8)
                one, two = (PrimeRolling(symbols, s).windows(length).view(np.int64) for s in (8, 9))
                full = lambda x, n=len(one): np.full(n, x, np.int64)
                yield pa.record_batch({"v": full(v), "c": full(c), "times": full(times), "at": np.arange(len(one), dtype=np.int32), "one": one, "two": two})
    return cut


def _passage(length: int) -> Column:
    return F.substring(F.col("bytes"), F.col("_r.start") + 1, F.col("_r.windows") + (length - 1))


def repeat_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(d, t, spans): runs of repeated bytes per text, from rows (d, t, bytes). Runs of one text may overlap."""
    long_enough = texts.where(F.octet_length("bytes") >= length)
    found = stored(long_enough.select("d", "t", "bytes").mapInArrow(_occurrences(length, anchor), _OCCURRENCES), "passages")
    again = found.groupBy("v").agg(F.count("*").alias("_n"), F.max("twice").alias("_twice")).where((F.col("_n") > 1) | F.col("_twice")).select("v")
    candidates = found.join(again, "v")
    distinct = stored(candidates.groupBy("v", "c").agg(F.count("*").alias("times"), F.max("windows").alias("windows"), F.min(F.struct("d", "t", "start")).alias("_at")), "distinct-passages")
    large = distinct.groupBy("v").agg(F.sum(F.col("windows") + (length - 1)).alias("_b")).where(F.col("_b") > key_bytes).select("v", F.lit(True).alias("large"))
    wanted = distinct.join(large, "v", "left").select(
        F.col("_at.d").alias("d"), F.col("_at.t").alias("t"), F.struct(F.col("_at.start").alias("start"), "windows", "v", "c", "times", F.coalesce("large", F.lit(False)).alias("large")).alias("_r"),
    ).groupBy("d", "t").agg(F.collect_list("_r").alias("_rs"))
    cut = texts.select("d", "t", "bytes").join(wanted, ["d", "t"]).select("bytes", F.explode("_rs").alias("_r"))
    cut = cut.select("_r.v", "_r.c", "_r.times", "_r.large", _passage(length).alias("passage"))

    small = cut.where("not large").select("v", "c", (F.col("times") > 1).alias("more"), "passage")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    marks = small.repartition(parts, "v").sortWithinPartitions("v", "c").mapInArrow(_indexed(length), _SPANS)

    windows = cut.where("large").select("v", "c", "times", "passage").dropDuplicates(["v", "c"]).mapInArrow(_windows(length), "v long, c long, times long, at int, one long, two long")
    counts = windows.groupBy("one", "two").agg(F.sum("times").alias("_n")).where("_n > 1").drop("_n")
    counted = windows.join(counts, ["one", "two"]).groupBy("v", "c").agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + length))).alias("spans"))

    placed = F.transform("spans", lambda x: x + F.col("start"))
    return candidates.join(marks.unionByName(counted), ["v", "c"]).groupBy("d", "t").agg(F.flatten(F.collect_list(placed)).alias("spans"))


def _merged(pairs: np.ndarray) -> np.ndarray:
    """Maximal runs of (from, to) rows: touching runs are one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    return np.stack([pairs[new, 0], reach[np.append(np.nonzero(new)[0][1:], len(pairs)) - 1]], 1)


def _removed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        kept, runs = [], []
        for text, s in zip(texts, spans, strict=True):
            if text is None or s is None or len(s) == 0:
                kept.append(None)
                runs.append(None)
                continue
            m = _merged(np.asarray(s).reshape(-1, 2))
            at = [0, *m.reshape(-1).tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
            runs.append(m.reshape(-1).astype(np.int32))
        yield pd.DataFrame({"kept": pd.Series(kept, dtype=object), "runs": pd.Series(runs, dtype=object)})


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, bytes (of the text in UTF-8), kept (binary) and runs (from, to, ...; null if none) for every row of ``docs``.

    A null text counts as empty. A kept text may end or begin inside a character, as bytes are what is judged. Rows that repeat a
    document are copies of each other. Other columns are ignored.
    """
    if not 0 < anchor <= length:
        raise ValueError("the anchor must not be longer than the repeat")
    raw = empty_if_null(F.col("text").cast("string")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(raw).alias("t"), raw.alias("bytes"),
    )
    marked = rows.join(repeat_spans(rows, length, anchor, key_bytes), ["d", "t"], "left")
    cut = F.pandas_udf(_removed, "kept binary, runs array<int>")(F.when(F.col("spans").isNotNull(), F.col("bytes")), "spans")
    return marked.withColumn("_c", cut).select("doc_id", "bytes", F.coalesce("_c.kept", "bytes").alias("kept"), F.col("_c.runs").alias("runs"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and the remaining text, where bytes of a character cut in two become the replacement character."""
    n = F.octet_length("bytes").cast("long")
    return without_repeats(docs).select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"),
        F.coalesce((F.size("runs") / 2).cast("long"), F.lit(0)).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )
