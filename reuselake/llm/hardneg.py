"""Hard-negative mining with exact integer scores from a residue-number-system matrix product.

Vectors become whole numbers. Anchors and rows are packed into blocks of a bounded size, every block of anchors meets every block of
rows once, and a block pair is one matrix product per prime: components are reduced to signed residues of a prime below 1024, so a float32
product over 64 components is exact (510 * 510 * 64 < 2**24). Balanced mixed-radix digits (Chinese remaindering)
give back the signed score; so many primes are used as the largest possible score of the block pair needs.

Positives are found first: per anchor the best rows of its own label. With their scores known, a second pass keeps, for each positive, the
best rows of other labels in the score window [ratio * positive, positive]. A block pair sends on only its best few for each positive, so
what is merged afterwards does not hold any full score matrix.

Rows with a null label, a null vector, or any null or non-finite component take no part. Neither do rows with a component
whose square times the vector's length passes 2**58, whose scores would not be longs. Vectors of different lengths
never meet. Every row is a row of its own, also where a vec_id repeats; a null vec_id is larger than all others and no anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reuselake.llm.common import stored

POSITIVES, NEGATIVES = 5, 5
ANCHOR_EVERY = 100
SCALE = 256
#: Bytes of a block of rows, and of a block of anchors, at 4 bytes a component.
ROW_BLOCK, ANCHOR_BLOCK = 2_000_000, 250_000
#: Components that one float32 product sums exactly.
SLICE = 64
LARGEST_SCORE = 1 << 58
_NONE = np.iinfo(np.int64).min


def primes_below(limit: int, count: int) -> list[int]:
    found: list[int] = []
    p = limit - 1
    while len(found) < count:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
        p -= 1
    return found


PRIMES = primes_below(1 << 10, 6)


def primes_for(bound: int) -> list[int]:
    """So many primes that scores up to ``bound`` in size are told apart."""
    product = 1
    for k, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound:
            return PRIMES[:k]
    raise ValueError("scores of this size need more primes")


def _signed(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exactly, from float32 products of residues."""
    largest = lambda x: int(np.abs(x).max(initial=0))
    primes = primes_for(max(1, a.shape[1] * largest(a) * largest(b)))
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        ra, rb = _signed(a, p).astype(np.float32), _signed(b, p).astype(np.float32)
        residue = np.zeros((len(a), len(b)), np.int32)
        for at in range(0, a.shape[1], SLICE):
            residue = _signed(residue + (ra[:, at : at + SLICE] @ rb[:, at : at + SLICE].T).astype(np.int32), p)
        # the k-th digit: what is left of the residue after the digits before, divided by their primes
        weight = 1
        for digit, q in zip(digits, primes[:k], strict=True):
            residue = _signed(residue - digit * weight % p, p)
            weight = weight * q % p
        digits.append(_signed(residue * pow(weight, -1, p), p))
    out = digits[-1].astype(np.int64)
    for digit, p in zip(digits[-2::-1], primes[-2::-1], strict=True):
        out = out * p + digit
    return out


def first_of(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` highest values of each row above ``_NONE``; of equal values the earlier columns."""
    count = min(count, scores.shape[1])
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.nonzero((scores > _NONE).any(1))[0]
    scores = scores[some]
    least = np.partition(scores, -count, axis=1)[:, -count, None]
    above, equal = scores > least, (scores == least) & (scores > _NONE)
    chosen = above | equal & (np.cumsum(equal, axis=1) <= count - above.sum(1, keepdims=True))
    row, column = np.nonzero(chosen)
    return some[row], column


def prepared(embeddings: DataFrame, relabel: Column, anchor: Column) -> DataFrame:
    """Rows that take part: row, vec_id, label (after ``relabel``), v (whole numbers), n (their number), anchor."""
    taken = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    infinite = F.lit(float("inf"))
    sound = ~F.exists("x", lambda c: F.coalesce(c.isNull() | F.isnan(c) | (F.abs(c) == infinite), F.lit(True)))
    most = F.coalesce(F.array_max(F.transform("x", lambda c: F.abs(F.floor(c * SCALE).cast("double")))), F.lit(0.0))
    fits = most * most * F.greatest(F.size("x"), F.lit(1)) <= float(LARGEST_SCORE)
    rows = taken.where("label is not null and x is not null").where(sound).where(fits)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "vec_id", relabel.cast("long").alias("label"),
        F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"), F.size("x").alias("n"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )


_BLOCK = "n int, part long, rows array<long>, ids array<long>, labels array<long>, vectors binary"


def _list(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64(), mask=mask))


def _packed(table: pa.Table) -> pa.Table:
    """One block of the rows of a group, ordered by label, then vec_id (null last), then row."""
    null = table["vec_id"].is_null().to_numpy(zero_copy_only=False)
    ids = table["vec_id"].fill_null(0).to_numpy()
    row, label = table["row"].to_numpy(), table["label"].to_numpy()
    order = np.lexsort((row, ids, null, label))
    n = table["n"][0].as_py()
    vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(len(row), n)[order]
    block = {
        "n": pa.array([n], pa.int32()), "part": table["part"][:1], "rows": _list(row[order]), "ids": _list(ids[order], null[order]), "labels": _list(label[order]),
        "vectors": pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
    }
    if "windows" in table.column_names:
        block["windows"] = _lists(table["windows"].combine_chunks().take(pa.array(order)))
    return pa.table(block)


def _lists(windows: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(windows)], pa.int32()), windows.cast(pa.list_(pa.int64())))


def _blocks(rows: DataFrame, of: str, block_bytes: int) -> DataFrame:
    """Packed blocks of about ``block_bytes``; ``of`` has each length's number of rows. Rows are dealt by a hash, so blocks are even."""
    parts = F.ceil(F.col(of) * F.greatest("n", F.lit(1)) * 4 / block_bytes)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.greatest(parts, F.lit(1))))
    schema = _BLOCK + (", windows array<array<long>>" if "windows" in rows.columns else "")
    cols = ["n", "part", "row", "vec_id", "label", "v", *(["windows"] if "windows" in rows.columns else [])]
    return dealt.select(*cols).groupBy("n", "part").applyInArrow(_packed, schema)


def _met(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors of the same length; each pair is a key of its own, so none gathers many blocks."""
    of = lambda blocks, name: blocks.groupBy("n").agg((F.max("part") + 1).alias(name))
    left = rows.join(of(anchors, "other"), "n").withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1))).drop("other")
    right = anchors.withColumnRenamed("part", "ask").join(of(rows, "other"), "n").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1))).drop("other")
    names = {c: f"a_{c}" for c in right.columns if c not in ("n", "ask", "part")}
    return left.join(right.withColumnsRenamed(names), ["n", "ask", "part"])


def _read(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    at = lambda name: batch.column(batch.schema.get_field_index(prefix + name))
    n = batch.column(batch.schema.get_field_index("n"))[i].as_py()
    rows, labels = (at(c)[i].values.to_numpy() for c in ("rows", "labels"))
    return rows, at("ids")[i].values, labels, np.frombuffer(at("vectors")[i].as_buffer(), "<i8").reshape(len(rows), n)


_FOUND = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _found(anchor_rows: np.ndarray, slot: int, rows: np.ndarray, ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
    ids = ids if isinstance(ids, pa.Array) else pa.array(ids)
    return pa.record_batch([pa.array(anchor_rows), pa.array(np.full(len(rows), slot, np.int32)), pa.array(rows), ids, pa.array(scores)], schema=_FOUND)


def _find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block pair and anchor the best other rows of its label. Blocks are ordered by label, so only products within a label are made."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, ids, labels, vectors = _read(batch, i, "")
            a_rows, _, a_labels, a_vectors = _read(batch, i, "a_")
            for label in np.intersect1d(labels, a_labels):
                b, e = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
                p, q = np.searchsorted(a_labels, label, "left"), np.searchsorted(a_labels, label, "right")
                scores = exact_scores(a_vectors[p:q], vectors[b:e])
                scores[a_rows[p:q, None] == rows[None, b:e]] = _NONE
                r, c = first_of(scores, POSITIVES)
                if len(r):
                    yield _found(a_rows[p + r], 0, rows[b + c], ids.take(pa.array(b + c)), scores[r, c])


def _find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block pair, anchor and positive the best rows of other labels within the positive's window."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, ids, labels, vectors = _read(batch, i, "")
            a_rows, _, a_labels, a_vectors = _read(batch, i, "a_")
            windows = batch.column(batch.schema.get_field_index("a_windows"))[i].as_py()
            order = np.lexsort((rows, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))  # ties by vec_id
            scores = exact_scores(a_vectors, vectors[order])
            scores[a_labels[:, None] == labels[None, order]] = _NONE
            for slot in range(max(map(len, windows), default=0)):
                some = np.array([k for k, w in enumerate(windows) if slot < len(w)])
                positive = np.array([windows[k][slot] for k in some])[:, None]
                s = scores[some]
                inside = (s <= positive) & (5 * s >= 4 * positive) & (s > _NONE)
                kept = np.where(inside, s, _NONE)
                r, c = first_of(kept, NEGATIVES)
                if len(r):
                    at = order[c]
                    yield _found(a_rows[some[r]], slot, rows[at], ids.take(pa.array(at)), kept[r, c])


def _best(found: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def hard_negatives(embeddings: DataFrame, relabel: Column, anchor: Column) -> DataFrame:
    """For each anchor row and each of its positives the negatives nearest below it.

    ``relabel`` and ``anchor`` are columns over (vec_id, label): the label that counts, and whether a row is an anchor. Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. An anchor without positives, or a positive
    without a negative in its window, gives no row.
    """
    rows = stored(prepared(embeddings, relabel, anchor), "vectors")
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows_of"), F.sum(F.col("anchor").cast("long")).alias("anchors_of"))
    rows = rows.join(sizes, "n")
    anchors = rows.where("anchor")
    blocks = stored(_blocks(rows, "rows_of", ROW_BLOCK), "row-blocks")
    asked = stored(_blocks(anchors, "anchors_of", ANCHOR_BLOCK), "anchor-blocks")
    kinds = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in _FOUND)
    found = _met(blocks, asked).mapInArrow(_find_positives, kinds)
    positives = stored(_best(found, ["anchor_row"], POSITIVES), "positives")

    windows = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("_w"))
    windows = windows.select("row", F.col("_w.score").alias("windows"))
    asking = stored(_blocks(anchors.join(windows, "row"), "anchors_of", ANCHOR_BLOCK), "asking-blocks")
    near = _met(blocks, asking).mapInArrow(_find_negatives, kinds)
    best = _best(near, ["anchor_row", "slot"], NEGATIVES)
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    of = positives.select("anchor_row", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(of, ["anchor_row", "slot"]).join(ids, "anchor_row").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def digest(embeddings: DataFrame) -> DataFrame:
    """Every vec_id divisible by 100 asks; every seventh vec_id counts under the next label."""
    relabel = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(embeddings, relabel, F.pmod("vec_id", F.lit(ANCHOR_EVERY)) == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""
