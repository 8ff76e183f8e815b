"""Duplicate detection over a text corpus: set-similarity joins, fingerprints, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reuselake.operators.skew import salted_join, shuffled
from reuselake.session import stored

# -- exact duplicates -----------------------------------------------------------------------------


def exact_duplicates(df: DataFrame, id: str = "id", keys=("language", "dialect", "fingerprint")) -> DataFrame:
    """Members of groups with the same fingerprint, each with the group's first id and size.

    Groups are reported as member-to-first rows, never as all pairs of a group. The keys are stored first,
    so that the rules of a computed key run once, not for groups and members each.
    """
    df = stored(df.select(id, *keys), "keys")
    groups = df.groupBy(*keys).agg(F.min(id).alias("first_id"), F.count("*").alias("members")).filter("members > 1")
    return salted_join(df, groups, list(keys), id).select(id, *keys, "first_id", "members")


def schema_duplicates(contract: DataFrame, name: str = "dataset", grain: str | None = None) -> DataFrame:
    """Datasets whose sorted columns, types and grain are the same."""
    field = F.concat_ws(" ", "column_name", F.lower("type"), *([F.col(grain)] if grain else []))
    shapes = contract.groupBy(name).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_set(field)), ","), 256).alias("shape")
    )
    return same_hash(shapes, name, "shape")


def metric_duplicates(fields: DataFrame, name: str = "metric") -> DataFrame:
    """Metrics whose sorted field/value lists are the same, blanks around values ignored."""
    pair = F.concat_ws("=", "field", F.trim("value"))
    defs = fields.groupBy(name).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_set(pair)), ","), 256).alias("definition")
    )
    return same_hash(defs, name, "definition")


def same_hash(df: DataFrame, name: str, key: str) -> DataFrame:
    groups = df.groupBy(key).agg(F.min(name).alias(f"first_{name}"), F.count("*").alias("members")).filter("members > 1")
    return salted_join(df, groups, key, name).select(name, f"first_{name}", "members", key)


# -- set-similarity join --------------------------------------------------------------------------


def _hashed(df: DataFrame, id: str, elements: str, by: list[str]) -> DataFrame:
    sets = F.array_distinct(F.transform(elements, lambda e: F.xxhash64(e)))  # copies of ``elements`` count once
    return df.select(F.col(id).alias("_id"), *by, sets.alias("_set")).filter(F.size("_set") > 0)


def _need(n, num: int, den: int):
    """Smallest overlap a set of size ``n`` must have with any partner: ceil(n * num / den)."""
    return F.expr(f"cast((cast({n} as bigint) * {num} + {den} - 1) div {den} as int)")


#: Bits of a table of keys that may occur on the other side of a join: a fixed size, whatever the input.
SEEN_BITS = 1 << 26
_WORD = 1 << 15


def seen_table(hashes: DataFrame) -> Broadcast:
    """Bit table of the 64-bit hashes in the only column: two bits for each, ``SEEN_BITS`` in all reach the driver and the tasks."""
    h = F.col(hashes.columns[0])
    places = F.array(F.pmod(h, F.lit(SEEN_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(SEEN_BITS)))
    bits = hashes.select(F.explode(places).alias("_p")).groupBy(F.floor(F.col("_p") / _WORD).alias("_w")).agg(F.bitmap_construct_agg(F.col("_p") % _WORD).alias("_b"))
    table = np.zeros((SEEN_BITS // _WORD, _WORD // 8), np.uint8)
    for row in bits.filter("_w IS NOT NULL").collect():
        table[row["_w"]] = np.frombuffer(row["_b"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = h.view(np.uint64)
    one, two = u & np.uint64(SEEN_BITS - 1), (u >> np.uint64(32)) & np.uint64(SEEN_BITS - 1)
    at = lambda p: (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (at(one) & at(two)).astype(bool)


def maybe_seen(table: Broadcast):
    """Column function: whether a 64-bit hash is in the table; sometimes true without being so, never false when it is."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(_in_table(table.value, h.to_numpy(np.int64)))

    return test


def maybe_enough(table: Broadcast, num: int, den: int):
    """Column function: whether so many hashes of a set may be in the table that it can reach the Jaccard similarity ``num / den`` with a set of them."""

    @F.pandas_udf("boolean")
    def test(sets: pd.Series) -> pd.Series:
        need = lambda x: max(1, -(-len(x) * num // den))
        return pd.Series([x is not None and len(x) > 0 and int(_in_table(table.value, x).sum()) >= need(x) for x in sets], dtype=bool)

    return test


#: So many pairs of one row meet in one place; a row of more pairs is repeated, one of fewer travels once.
MET = 64


def _beside(pairs: DataFrame, left: DataFrame, right: DataFrame, id: str, col: str, lname: str, rname: str) -> DataFrame:
    """Stored pairs with the column of both sides. Rows that surely have no partner are not shuffled, and a row is repeated
    only as often as its pairs fill places."""

    sides = {"left": (left, "right_id", lname), "right": (right, "left_id", rname)}
    places = {s: pairs.groupBy(f"{s}_id").agg(F.ceil(F.count("*") / MET).alias("_places")) for s in sides}
    out = pairs  # first the places, while the pairs are narrow
    for s, (_, other, _) in sides.items():
        out = salted_join(out, places[s], f"{s}_id", other).withColumn(f"_{s}", F.pmod(F.xxhash64(other), "_places")).drop("_places")
    for s, (df, _, name) in sides.items():
        test = maybe_seen(seen_table(pairs.select(F.xxhash64(f"{s}_id"))))
        rows = df.filter(test(F.xxhash64(id))).select(F.col(id).alias(f"{s}_id"), F.col(col).alias(name)).join(shuffled(places[s]), f"{s}_id")
        rows = rows.withColumn(f"_{s}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_places") - 1))).drop("_places")
        out = out.join(shuffled(rows), [f"{s}_id", f"_{s}"]).drop(f"_{s}")
    return out


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, id: str, elements: str, threshold: tuple[int, int]) -> DataFrame:
    """The stored pairs that reach the threshold, by their real elements: left_id, right_id, overlap, left_size, right_size."""
    num, den = threshold
    both = _beside(pairs, left, right, id, elements, "_le", "_re")
    # a generator, so that the test of the overlap does not compute it a second time
    overlap = F.explode(F.array(F.size(F.array_intersect("_le", "_re")))).alias("overlap")
    return both.select("left_id", "right_id", overlap, F.size("_le").alias("left_size"), F.size("_re").alias("right_size")).filter(
        F.col("overlap") * den >= (F.col("left_size") + F.col("right_size") - F.col("overlap")) * num
    )


def candidate_pairs(
    left: DataFrame, right: DataFrame, threshold: tuple[int, int], id: str = "id", elements: str = "elements", by=(), ordered: bool = False
) -> DataFrame:
    """Pairs (left_id, right_id) that hold every pair of Jaccard similarity ``threshold`` or more, not yet verified.

    Prefix filter (Chaudhuri 2006, Bayardo 2007, Xiao 2008): elements are ordered by how many sets of ``right`` hold them. Two sets that reach the
    threshold must share one of their rarest ``n - ceil(t*n) + 1`` elements, so only those are
    joined. Elements unknown to ``right`` are the rarest of all and are dropped at once, and a
    left set with too few known elements leaves before the join. What two sets share from a common element on is at most what either has left there;
    at the first one that must be enough. The threshold is a fraction of
    whole numbers; with ``(0, 1)`` every pair that shares anything is returned. Elements are compared by 64-bit hashes.
    With ``ordered`` both sides are one table, and only pairs whose left id is the smaller are returned; an element of one set alone is unknown then.
    """
    num, den = threshold
    by = list(by)
    lset, rset = _hashed(left, id, elements, by), _hashed(right, id, elements, by)
    freq = (
        rset.select(*by, F.explode("_set").alias("_h")).groupBy(*by, "_h").agg(F.count("*").alias("_f"))
    )
    if ordered:
        freq = freq.filter("_f > 1")

    def prefixes(sets: DataFrame) -> DataFrame:
        items = sets.select("_id", *by, F.size("_set").alias("_n"), F.explode("_set").alias("_h"))
        ranked = (
            salted_join(items, freq, [*by, "_h"], "_id")
            .groupBy("_id", *by, "_n")
            .agg(F.sort_array(F.collect_list(F.struct("_f", "_h"))).alias("_known"))
        )
        need = _need("_n", num, den)
        unknown = F.col("_n") - F.size("_known")
        length = F.least(F.col("_n"), F.col("_n") - need + 1) - unknown
        return (
            ranked.filter(F.size("_known") >= F.greatest(need, F.lit(1)))
            .withColumns({"_len": length, "_left": F.size("_known")})
            .filter("_len > 0")
            .select("_id", *by, "_n", "_left", F.posexplode(F.slice("_known", F.lit(1), F.col("_len"))).alias("_i", "_e"))
            .select("_id", *by, F.col("_n").cast("bigint").alias("_n"), (F.col("_left") - F.col("_i")).alias("_left"), F.col("_e._h").alias("_h"))
        )

    a = prefixes(lset)
    if ordered:
        a = stored(a, "prefixes")
    b = (a if ordered else prefixes(rset)).withColumnsRenamed({"_id": "right_id", "_n": "_rn", "_left": "_rleft"})
    met = salted_join(a.withColumnsRenamed({"_id": "left_id", "_n": "_ln", "_left": "_lleft"}), b, [*by, "_h"], "left_id").filter(
        (F.col("_ln") * num <= F.col("_rn") * den) & (F.col("_rn") * num <= F.col("_ln") * den)
        & (F.least("_lleft", "_rleft") * (num + den) >= (F.col("_ln") + F.col("_rn")) * num)
    )
    if ordered:
        met = met.filter("left_id < right_id")
    return met.select("left_id", "right_id").distinct()


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: tuple[int, int], id: str = "id", elements: str = "elements", by=(), ordered: bool = False
) -> DataFrame:
    """All pairs whose element sets have Jaccard similarity of at least ``threshold``; exact, without comparing all pairs.

    Both inputs are read several times, so they should be stored tables, not long plans, and
    ``right`` should be the smaller side. The overlap of ``candidate_pairs``
    is counted on the real elements. Output: left_id, right_id, overlap, left_size, right_size.
    """
    pairs = stored(candidate_pairs(left, right, threshold, id, elements, by, ordered), "candidates")
    return _verified(pairs, left, right, id, elements, threshold).filter("overlap > 0")


def similar_rows(
    left: DataFrame, right: DataFrame, threshold: tuple[int, int], id: str = "id", elements: str = "elements", by=()
) -> DataFrame:
    """``similar_pairs`` for tables with many copies: each distinct set is joined once, and its
    pairs are handed to all rows that hold it.

    ``right`` should be the smaller side: a left row leaves before anything of it is stored or shuffled if too few of its elements can occur there.
    """
    num, den = threshold

    def sets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        keyed = df.select(
            F.col(id).alias("_row"), *by, F.col(elements).alias("elements"),
            # travels with every element, so 16 bytes
            F.unhex(F.md5(F.concat_ws("|", *by, F.array_join(F.sort_array(elements), "\x1f")))).alias("_set_id"),
        )
        keyed = stored(keyed, "sets")
        one = stored(keyed.groupBy("_set_id", *by).agg(F.any_value("elements").alias("elements")), "distinct-sets")
        return keyed.select("_row", "_set_id"), one

    rrows, rsets = sets(right)
    enough = maybe_enough(seen_table(_hashed(rsets, "_set_id", "elements", []).select(F.explode("_set"))), num, den)
    # a generator, so that the filter does not cut the texts a second time
    once = left.select(id, *by, F.explode(F.array(elements)).alias(elements))
    lrows, lsets = sets(once.filter(enough(F.array_distinct(F.transform(elements, lambda e: F.xxhash64(e))))))
    pairs = similar_pairs(lsets, rsets, threshold, id="_set_id", by=by)
    size = ["overlap", "left_size", "right_size"]
    wide = salted_join(
        lrows.withColumnsRenamed({"_row": "left_row", "_set_id": "left_id"}), pairs, "left_id", "left_row"
    ).select("left_row", "right_id", *size)
    return salted_join(
        wide, rrows.withColumnsRenamed({"_row": "right_row", "_set_id": "right_id"}), "right_id", "left_row"
    ).select(F.col("left_row").alias("left_id"), F.col("right_row").alias("right_id"), *size)


def jaccard() -> F.Column:
    union = F.col("left_size") + F.col("right_size") - F.col("overlap")
    return F.round(F.col("overlap") / union, 4)


#: A bucket of more distinct texts than this is split by further min-hashes.
BUCKET = 64
#: Share of pairs at exactly the threshold that the bands may miss.
MISSED = 1e-6


def bands_for(threshold: float, missed: float = MISSED, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which at most ``most`` hashes miss a pair at the threshold with probability ``missed`` or less.

    A band is missed with probability 1 - t**rows, all of them with that to the power of their number.
    """
    best = (most, 1)
    for rows in range(1, 9):
        if threshold**rows >= 1:
            return 1, rows
        bands = int(np.ceil(np.log(missed) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def split_rounds(threshold: float, missed: float = MISSED) -> int:
    """How many further min-hashes, each alone, leave a pair at the threshold apart with probability ``missed``."""
    return int(np.ceil(np.log(missed) / np.log1p(-threshold))) if threshold < 1 else 1


#: Hashes of so many elements are mixed at once: several short sets, or one long one.
AT_ONCE = 1 << 13


def _least(sets: list[np.ndarray], seeds: np.ndarray) -> list[np.ndarray]:
    """For each set of hashes its least value under each seed."""
    out = np.empty((len(sets), len(seeds)), np.uint64)
    ends = np.cumsum([len(x) for x in sets])
    at = 0
    while at < len(sets):
        begin = ends[at] - len(sets[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + AT_ONCE, "right")))
        h = np.concatenate(sets[at:to]).view(np.uint64)
        starts = np.concatenate([[0], ends[at : to - 1] - begin]).astype(np.int64)
        v, w = np.empty_like(h), np.empty_like(h)
        for i, seed in enumerate(seeds):
            np.bitwise_xor(h, seed, out=v)
            v *= np.uint64(0x9E3779B97F4A7C15)
            np.right_shift(v, np.uint64(29), out=w)
            v ^= w
            v *= np.uint64(0xBF58476D1CE4E5B9)
            out[at:to, i] = np.minimum.reduceat(v, starts)
        at = to
    return list(out.view(np.int64))


def _minima(df: DataFrame, count: int) -> DataFrame:
    """``m``: the least of each of ``count`` hashes over the set, within the row (no shuffle)."""
    seeds = np.random.default_rng(7).integers(1, 1 << 63, count, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series(_least(list(sets), seeds))

    return df.withColumn("m", least(F.transform("_set", lambda e: F.xxhash64(e))))


#: How often a large bucket is split; what two splits leave together is all alike.
SPLITS = 2


def _bucket_pairs(keys: DataFrame, further: DataFrame, by: list[str], rounds: int) -> DataFrame:
    """Candidate pairs (left_id, right_id) of rows (_id, by, key).

    A bucket of up to ``BUCKET`` members gives its pairs. A larger one is cut by each of ``rounds`` further hashes alone (``further`` holds those
    of every split as _id, m; only members of large buckets meet it): what agrees in one of them meets there. What is large after the last split gives
    all its pairs, spread over many tasks. Every side grows with the input and repeats its rows, so none is broadcast.
    """
    key = [*by, "key"]
    out = None
    for split in range(SPLITS + 1):
        sizes = keys.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
        sized = stored(keys.join(shuffled(sizes), key), "buckets")
        small = sized.filter(F.col("_n") <= BUCKET).select("_id", *key)
        met = small.withColumnRenamed("_id", "left_id").join(shuffled(small.withColumnRenamed("_id", "right_id")), key)
        pairs = met.filter("left_id < right_id").select("left_id", "right_id")
        out = pairs if out is None else out.unionByName(pairs)
        large = sized.filter(F.col("_n") > BUCKET)
        if split == SPLITS or large.isEmpty():
            break
        own = further.select("_id", F.slice("m", 1 + split * rounds, rounds).alias("m"))
        each = large.join(shuffled(own), "_id").select("_id", *key, F.posexplode("m").alias("_i", "_h"))
        each = each.withColumn("_next", F.xxhash64("key", F.lit(split), F.col("_i") + 1 + split * rounds, "_h"))
        keys = each.select("_id", *by, F.col("_next").alias("key"))
    return out.unionByName(_all_of(large, key)).distinct()


def _all_of(large: DataFrame, key: list[str]) -> DataFrame:
    """All pairs of buckets that no further hash splits, each bucket spread over many tasks by blocks of its members."""
    dealt = large.withColumn("_b", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / BUCKET)))
    left = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_n") / BUCKET) - 1)))
    one = left.select(F.col("_id").alias("left_id"), *key, "_b", "_c")
    two = dealt.withColumnRenamed("_b", "_c").select(F.col("_id").alias("right_id"), *key, "_c")
    return one.join(shuffled(two), [*key, "_c"]).filter("left_id < right_id").select("left_id", "right_id")


def near_duplicates_lsh(
    df: DataFrame, id: str = "id", elements: str = "elements", threshold: tuple[int, int] = (4, 5), by=(), missed: float = MISSED,
) -> DataFrame:
    """Near-duplicates by min-hash bands: pairs of distinct texts, and copies beside their first.

    Rows of one element set are one text, named by its smallest id; each copy is reported beside it with full overlap, so
    copies cost one row each. Bands follow from the threshold, so that a pair at the threshold is missed with probability ``missed`` at most. Large
    buckets are split by further hashes, again with that probability (``near_duplicates_recall`` measures it), and every candidate
    is verified exactly. Texts without elements are in no pair.
    """
    by = list(by)
    num, den = threshold
    bands, rows = bands_for(num / den, missed)
    rounds = split_rounds(num / den, missed)
    keyed = df.select(
        F.col(id).alias("_id"), *by, F.col(elements).alias("_set"), F.size(elements).alias("_n"),
        F.unhex(F.sha2(F.concat_ws("|", *by, F.array_join(F.sort_array(elements), "\x1f")), 256)).alias("_of"),
    )
    keyed = stored(keyed, "sets").filter(F.size("_set") > 0)  # a filter before would cut the texts twice

    # hashes are taken where the sets lie; only they, not the sets, are brought together
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("m", b * rows + 1, F.lit(rows))))
    signed = _minima(keyed.select("_id", *by, "_of", "_n", "_set"), bands * rows + SPLITS * rounds)
    signed = signed.select("_id", *by, "_of", "_n", band.alias("_bands"), F.slice("m", bands * rows + 1, SPLITS * rounds).alias("m"))
    signed = signed.groupBy("_of", *by).agg(F.min("_id").alias("_id"), F.any_value("_n").alias("_n"), F.any_value("_bands").alias("_bands"), F.any_value("m").alias("m"))
    signed = stored(signed, "signatures")
    pairs = stored(_bucket_pairs(signed.select("_id", *by, F.explode("_bands").alias("key")), signed.select("_id", "m"), by, rounds), "bucket-pairs")

    firsts = signed.select("_id", "_of", *by, "_n")
    size = lambda side: shuffled(firsts.select(F.col("_id").alias(f"{side}_id"), F.col("_n").alias(f"_{side}")))
    can = F.least("_left", "_right") * den >= F.greatest("_left", "_right") * num  # what a pair shares is at most the smaller set
    pairs = pairs.join(size("left"), "left_id").join(size("right"), "right_id").filter(can).select("left_id", "right_id").distinct()
    pairs = stored(pairs, "sized-pairs")
    ids = pairs.select(F.explode(F.array("left_id", "right_id")).alias("_id"))
    wanted = shuffled(firsts.join(shuffled(ids.distinct()), "_id", "left_semi").select("_id", "_of").distinct())
    there = maybe_seen(seen_table(ids.select(F.xxhash64("_id"))))
    sets = keyed.select("_id", "_of", "_set").filter(there(F.xxhash64("_id"))).join(wanted, ["_id", "_of"])
    sets = stored(sets.groupBy("_id", "_of").agg(F.any_value("_set").alias("_set")), "paired-sets")
    near = _verified(pairs, sets, sets, "_id", "_set", threshold)
    n = F.col("_n")
    copies = salted_join(keyed.select("_id", "_of", "_n"), firsts.select("_of", F.col("_id").alias("_first")), "_of", "_id").filter("_id <> _first").select(
        F.col("_first").alias("left_id"), F.col("_id").alias("right_id"), n.alias("overlap"), n.alias("left_size"), n.alias("right_size"),
    )
    return near.unionByName(copies)


def near_duplicates_recall(df: DataFrame, id: str = "id", elements: str = "elements", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row: pairs of distinct sets that the exact join finds, those of them that the bands find, and the share."""
    sets = df.select(F.col(id).alias("id"), F.sort_array(elements).alias("elements")).filter(F.size("elements") > 0)
    same = [F.sha2(F.array_join("elements", "\x1f"), 256).alias("_of"), F.xxhash64("elements").alias("_h")]
    sets = stored(sets.groupBy(*same).agg(F.min("id").alias("id"), F.any_value("elements").alias("elements")).select("id", "elements"), "distinct-sets")
    exact = similar_pairs(sets, sets, threshold, ordered=True).select("left_id", "right_id")
    found = near_duplicates_lsh(sets, threshold=threshold).select("left_id", "right_id", F.lit(1).alias("_f"))
    return exact.join(found, ["left_id", "right_id"], "left").agg(
        F.count("*").alias("pairs"), F.count("_f").alias("found"), F.round(F.coalesce(F.count("_f") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 6).alias("recall"),
    )


# -- vectors --------------------------------------------------------------------------------------

#: Vectors of a group (a pivot's neighbourhood) that are packed into one block, and of a sample from which pivots are drawn.
BLOCK = 1024
PIVOTS = 256


def _matrix(rows) -> np.ndarray:
    """Vectors as the rows of a matrix; each is an array, or the bytes of one."""
    if isinstance(rows[0], bytes):
        return np.frombuffer(b"".join(rows), "float64").reshape(len(rows), -1)
    return np.vstack([np.asarray(r, dtype="float64") for r in rows])


def _units(rows) -> np.ndarray:
    """The vectors with length 1; a zero vector stays zero."""
    x = _matrix(rows)
    square = np.zeros(len(x))
    for column in x.T:  # one after the other, so that the order of a sum never depends on the batch
        square += column * column
    norm = np.sqrt(square)[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm != 0)


def vector_pivots(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", pivots: int = PIVOTS) -> np.ndarray:
    """Unit vectors of the smallest id hashes, one for each ``BLOCK`` rows but ``pivots`` at most, so a bounded number reaches the driver.

    Which ones they are changes the work, not the result.
    """
    pivots = min(pivots, max(1, vectors.count() // BLOCK))
    some = vectors.filter(F.col(vec).isNotNull()).select(F.xxhash64(id).alias("_h"), F.col(id).alias("_id"), F.col(vec).cast("array<double>").alias("v"))
    got = some.orderBy("_h", "_id").limit(pivots).select("v").collect()
    return _units([r["v"] for r in got]) if got else np.zeros((0, 0))


def vector_groups(vectors: DataFrame, pivots: np.ndarray, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Blocks of vectors around the pivot that is nearest to them, one row per block of about ``BLOCK`` vectors.

    Columns: pivot, part, ids, vecs (unit vectors, each as the bytes of its doubles), low and high (range of the distances from the pivot). A group that is larger than a
    block is cut into rings by distance, so hot regions give more blocks, not larger ones.
    """
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            x = _units(list(pdf["v"]))
            far = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))
            at = far.argmin(1)
            yield pd.DataFrame({"id": pdf["id"], "v": [r.tobytes() for r in x], "pivot": at.astype("int32"), "far": far[np.arange(len(x)), at]})

    rows = vectors.filter(F.col(vec).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    placed = stored(rows.mapInPandas(nearest, "id bigint, v binary, pivot int, far double"), "placed-vectors")
    # rings: distances in steps, running counts of the steps decide where a block ends, and a step that overflows is cut by a hash
    steps = placed.groupBy("pivot", F.floor(F.col("far") * 4096).alias("step")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("ring", F.floor(F.coalesce(before, F.lit(0)) / BLOCK)).withColumn("cuts", F.ceil(F.col("n") / BLOCK))
    cut = placed.withColumn("step", F.floor(F.col("far") * 4096)).join(steps, ["pivot", "step"])
    cut = cut.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    return cut.groupBy("pivot", "ring", "cut").agg(
        F.collect_list("id").alias("ids"), F.collect_list("v").alias("vecs"), F.min("far").alias("low"), F.max("far").alias("high"),
    ).select("pivot", F.struct("ring", "cut").alias("part"), "ids", "vecs", "low", "high")


def _between(pivots: np.ndarray) -> np.ndarray:
    square = (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(0.0, square[:, None] + square[None] - 2 * pivots @ pivots.T))


def block_pairs(queries: DataFrame, candidates: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Every pair of blocks, with the least distance their vectors can have (triangle inequality over the two pivots).

    Only the blocks' ranges meet here, not their vectors: as many rows as pairs of blocks, each a few numbers.
    """
    far = _between(pivots)

    @F.pandas_udf("array<double>")
    def from_pivot(pivot: pd.Series) -> pd.Series:
        return pd.Series([far[p] for p in pivot])

    head = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in ("pivot", "part", "low", "high")))
    n = F.lit(SPREAD)
    q = head(queries, "q").withColumn("_far", from_pivot("q_pivot")).withColumn("_key", F.explode(F.sequence(F.lit(0), n - 1)))
    c = head(candidates, "c").withColumn("_key", F.pmod(F.xxhash64("c_pivot", "c_part"), n).cast("int"))
    apart = F.element_at("_far", F.col("c_pivot") + 1)
    least = F.greatest(F.lit(0.0), apart - F.col("q_high") - F.col("c_high"), F.col("q_low") - apart - F.col("c_high"), F.col("c_low") - apart - F.col("q_high"))
    return q.join(c, "_key").select("q_pivot", "q_part", "c_pivot", "c_part", least.alias("least"))


#: Over so many keys the blocks' ranges are dealt.
SPREAD = 64
_MARGIN = 1e-6


#: More products of a block pair than this are computed as one matrix.
FEW = 1 << 16


def _reaching(q: tuple, c: tuple, bar: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of c and rounded cosines of all pairs whose rounded cosine is ``bar`` of the query or more.

    A block is (ids, vectors, the same in single precision). Single precision finds what can reach the bar, by the bound of its error; only that is
    computed in double precision.
    """
    (qi, qv, q32), (ci, cv, c32) = q, c
    least = bar - 5.1e-5 - (qv.shape[1] + 4) * 1.2e-7
    i, j = np.divmod(np.flatnonzero((q32 @ c32.T >= least[:, None].astype("float32")).reshape(-1)), len(ci))
    sim = np.round((qv @ cv.T)[i, j] if len(i) > FEW else np.einsum("ij,ij->i", qv[i], cv[j]), 4)
    keep = sim >= bar[i]
    if skip_self:
        keep &= qi[i] != ci[j]
    return i[keep], j[keep], sim[keep]


def _block(ids, vecs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = _matrix(vecs)
    return np.asarray(ids), v, v.astype("float32")


class _Best:
    """The best ``k`` candidates so far of each query of a block, by cosine and then the smaller id."""

    def __init__(self, block: tuple, k: int, skip_self: bool):
        self.block, self.k, self.skip_self = block, k, skip_self
        self.sim = np.full((len(block[0]), k), -np.inf)
        self.ids = np.full((len(block[0]), k), np.iinfo(np.int64).max)

    def meet(self, c: tuple) -> None:
        bar = self.sim[:, -1]
        if np.isneginf(bar).any() and len(c[0]) > self.k:  # no bar yet: the k-th of this block
            sim = np.round(self.block[1] @ c[1].T, 4)
            no = np.isnan(sim) | (self.skip_self & (self.block[0][:, None] == c[0]))
            bar = np.fmax(bar, np.partition(np.where(no, -np.inf, sim), -self.k, axis=1)[:, -self.k])
        i, j, sim = _reaching(self.block, c, bar, self.skip_self)
        new = (sim > self.sim[i, -1]) | (c[0][j] < self.ids[i, -1])
        i, j, sim = i[new], j[new], sim[new]
        if not len(i):
            return
        rows = np.unique(i)
        i = np.concatenate([i, np.repeat(rows, self.k)])
        ids, sim = np.concatenate([c[0][j], self.ids[rows].reshape(-1)]), np.concatenate([sim, self.sim[rows].reshape(-1)])
        order = np.lexsort((ids, -sim, i))
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        take = order[(first[:, None] + np.arange(self.k)).reshape(-1)]  # each row has its k old places, so k at least
        self.ids[rows], self.sim[rows] = ids[take].reshape(-1, self.k), sim[take].reshape(-1, self.k)

    def rows(self) -> pd.DataFrame:
        keep = np.isfinite(self.sim)
        return pd.DataFrame({"query_id": np.repeat(self.block[0], keep.sum(axis=1)), "candidate_id": self.ids[keep], "cosine": self.sim[keep]})


_HITS = "query_id bigint, candidate_id bigint, cosine double"


def _best_of(pairs: DataFrame, q: DataFrame, c: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The best ``k`` candidates of each query within each of a few block pairs."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                best = _Best(_block(row.q_ids, row.q_vecs), k, skip_self)
                best.meet(_block(row.c_ids, row.c_vecs))
                yield best.rows()

    return _with_vectors(pairs, q, c).mapInPandas(score, _HITS)


def _best_of_tiles(pairs: DataFrame, q: DataFrame, c: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """The best ``k`` candidates of each query within each tile of block pairs."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {}
        for new, key, block, wanted in _tile_rows(batches):
            if new:
                yield from (b.rows() for b in best.values())
                best = {}
            if wanted is None:
                best[key] = _Best(block, k, skip_self)
            else:
                for other in wanted:
                    best[other].meet(block)
        yield from (b.rows() for b in best.values())

    return _tiles(pairs, q, c).mapInPandas(score, _HITS)


#: A tile has so many query blocks and so many candidate blocks, or fewer where there is little of them.
TILE = 64


def _tiles(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Block pairs with the ids and vectors of both, dealt by tiles: the query blocks of a tile first, then its candidate blocks with the query blocks they ask for.

    Each block is sent once to every tile that asks for it, and each task holds the query blocks of one tile and one candidate block.
    """
    spread = int(np.ceil(np.sqrt(4 * q.sparkSession.sparkContext.defaultParallelism)))
    cuts = lambda df: max(-(-(n := df.count()) // TILE), min(n, spread), 1)
    rows, columns = cuts(q), cuts(c)
    at = lambda side, n: F.pmod(F.xxhash64(f"{side}_pivot", f"{side}_part"), F.lit(n))
    key = lambda side: F.concat_ws(":", f"{side}_pivot", f"{side}_part.ring", f"{side}_part.cut")
    tile = (at("q", rows) * columns + at("c", columns)).alias("tile")
    asked = {
        "q": pairs.select(tile, "q_pivot", "q_part").distinct().withColumn("wanted", F.lit(None).cast("array<string>")),
        "c": pairs.groupBy(tile, "c_pivot", "c_part").agg(F.collect_set(key("q")).alias("wanted")),
    }
    sent = [
        asked[s].join(shuffled(df.select(F.col("pivot").alias(f"{s}_pivot"), F.col("part").alias(f"{s}_part"), "ids", "vecs")), [f"{s}_pivot", f"{s}_part"])
        .select("tile", key(s).alias("key"), "ids", "vecs", "wanted")
        for s, df in (("q", q), ("c", c))
    ]
    kind = F.col("wanted").isNotNull()
    return sent[0].unionByName(sent[1]).repartition(rows * columns, "tile").sortWithinPartitions("tile", kind, "key")


def _tile_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(first of its tile, key, block, query blocks that are asked for) of each row."""
    at = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            yield row.tile != at, row.key, _block(row.ids, row.vecs), row.wanted
            at = row.tile


#: So many query blocks travel together: a candidate block is sent to each such group once, not to each block.
GROUP = 32


def _with_vectors(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Block pairs with the ids and vectors of both. A candidate block is shuffled once for each group of query blocks that asks for it."""
    key = ["q_pivot", "q_part"]
    groups = max(1, -(-q.count() // GROUP))
    group = F.pmod(F.xxhash64(*key), F.lit(groups)).alias("_group")
    block = lambda *more: F.struct(F.col("q_pivot").alias("pivot"), F.col("q_part").alias("part"), *more)
    blocks = q.withColumnsRenamed({"pivot": "q_pivot", "part": "q_part"}).groupBy(group).agg(F.collect_list(block("ids", "vecs")).alias("_blocks"))
    asked = pairs.groupBy(group, "c_pivot", "c_part").agg(F.collect_set(block()).alias("_asked"))
    side = c.select(F.col("pivot").alias("c_pivot"), F.col("part").alias("c_part"), F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    met = salted_join(asked.join(side, ["c_pivot", "c_part"]), blocks, "_group", ["c_pivot", "c_part"], 4)
    wanted = F.filter("_blocks", lambda x: F.array_contains("_asked", F.struct(x["pivot"].alias("pivot"), x["part"].alias("part"))))
    return met.select("c_ids", "c_vecs", F.explode(wanted).alias("_q")).select(
        F.col("_q.ids").alias("q_ids"), F.col("_q.vecs").alias("q_vecs"), "c_ids", "c_vecs",
    )


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "candidate_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _two_phases(queries: DataFrame, candidates: DataFrame, k: int, id: str, vec: str, skip_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked hits, all block pairs, block pairs that were multiplied)."""
    pivots = vector_pivots(candidates, id, vec)
    if not len(pivots):
        none = queries.sparkSession.createDataFrame([], "query_id bigint, candidate_id bigint, cosine double, rank int")
        return none, none, none
    c = stored(vector_groups(candidates, pivots, id, vec), "vector-blocks")
    q = c if queries is candidates else stored(vector_groups(queries, pivots, id, vec), "vector-blocks")
    pairs = stored(block_pairs(q, c, pivots), "block-pairs")
    # first the nearest blocks of each query block, as many as surely hold k others
    close = Window.partitionBy("q_pivot", "q_part").orderBy("least", "c_pivot", "c_part")
    sizes = c.select(F.col("pivot").alias("c_pivot"), F.col("part").alias("c_part"), F.size("ids").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(close.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["q_pivot", "q_part", "c_pivot", "c_part"]
    first = stored(pairs.join(sizes, ["c_pivot", "c_part"]).withColumn("_ahead", ahead).filter(F.col("_ahead") <= k).select(*key), "first-pairs")
    hits = stored(_first_k(_best_of(first, q, c, k, skip_self), k), "first-hits")
    # the k-th score so far bounds the distance of anything better: |x - y|^2 = 2 - 2 cos for unit vectors
    kth = hits.groupBy("query_id").agg(F.min("cosine").alias("_s"), F.count("*").alias("_n"))
    reach = q.select("pivot", "part", F.explode("ids").alias("query_id")).join(kth, "query_id", "left")
    bound = F.when(F.coalesce("_n", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("_s") - 0.0001))))
    reach = reach.groupBy(F.col("pivot").alias("q_pivot"), F.col("part").alias("q_part")).agg(F.max(bound).alias("_reach"))
    rest = pairs.join(first, key, "left_anti").join(reach, ["q_pivot", "q_part"]).filter(F.col("least") <= F.col("_reach") + _MARGIN).select(*key)
    rest = stored(rest, "other-pairs")
    every = hits.drop("rank").unionByName(_best_of_tiles(rest, q, c, k, skip_self))
    return _first_k(every, k), pairs, first.unionByName(rest)


def embedding_topk(
    queries: DataFrame, candidates: DataFrame, k: int = 5, id: str = "vec_id", vec: str = "embedding",
    threshold: float | None = None, skip_self: bool = True,
) -> DataFrame:
    """The ``k`` most similar candidates per query by cosine, rounded to 4, optionally flagged. Exact.

    Vectors are grouped around pivots, and each group's blocks know their range of distances from the pivot. A query block meets
    its nearest blocks first; the worst k-th score so far is then the bound by which the triangle inequality skips the others. Of each
    block pair at most ``k`` rows per query are shuffled. Ties go to the smaller id; a vector is not compared with
    itself unless ``skip_self`` is off. Zero vectors have cosine 0; rows without a vector take no part.
    """
    out, _, _ = _two_phases(queries, candidates, k, id, vec, skip_self)
    return out if threshold is None else out.withColumn("flagged", F.col("cosine") >= threshold)


def topk_work(queries: DataFrame, candidates: DataFrame, k: int = 5, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row: block pairs in all, those multiplied by ``embedding_topk``, and the share skipped."""
    _, pairs, used = _two_phases(queries, candidates, k, id, vec, True)
    return _share(pairs, used)


def _share(pairs: DataFrame, used: DataFrame) -> DataFrame:
    counts = pairs.select(F.lit(0).alias("_u")).unionByName(used.select(F.lit(1).alias("_u"))).agg(
        F.count_if(F.col("_u") == 0).alias("block_pairs"), F.count_if(F.col("_u") == 1).alias("multiplied"),
    )
    return counts.withColumn("skipped_share", F.round(1 - F.col("multiplied") / F.greatest("block_pairs", F.lit(1)), 4))


def embedding_pairs(
    queries: DataFrame, candidates: DataFrame, threshold: float, id: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """All query/candidate pairs with rounded cosine of at least ``threshold``, smaller id first
    where both sides hold the pair. Block pairs that lie too far apart are skipped; where both sides are one table each pair of blocks meets once."""
    found = _close_pairs(queries, candidates, threshold, id, vec)
    return found[0]


def pairs_work(queries: DataFrame, candidates: DataFrame, threshold: float, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row: block pairs in all, those multiplied by ``embedding_pairs``, and the share skipped."""
    _, pairs, used = _close_pairs(queries, candidates, threshold, id, vec)
    return _share(pairs, used)


def _close_pairs(queries: DataFrame, candidates: DataFrame, threshold: float, id: str, vec: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pivots = vector_pivots(candidates, id, vec)
    if not len(pivots):
        none = queries.sparkSession.createDataFrame([], "a bigint, b bigint, score double")
        return none, none, none
    one = queries is candidates
    c = stored(vector_groups(candidates, pivots, id, vec), "vector-blocks")
    q = c if one else stored(vector_groups(queries, pivots, id, vec), "vector-blocks")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, found, held = {}, [], 0
        for new, key, block, wanted in _tile_rows(batches):
            if new:
                near = {}
            if wanted is None:
                near[key] = block
                continue
            for other in wanted:
                qi, ci = near[other][0], block[0]
                i, j, sim = _reaching(near[other], block, np.full(len(qi), threshold), False)
                a, b = qi[i], ci[j]
                keep = a != b if one else a < b
                found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], sim[keep]))
                held += int(keep.sum())
                if held > FEW:
                    yield pd.DataFrame(dict(zip(("a", "b", "score"), map(np.concatenate, zip(*found)))))
                    found, held = [], 0
        if found:
            yield pd.DataFrame(dict(zip(("a", "b", "score"), map(np.concatenate, zip(*found)))))

    pairs = block_pairs(q, c, pivots)
    if one:
        pairs = pairs.filter(F.struct("q_pivot", "q_part") <= F.struct("c_pivot", "c_part"))
    pairs = stored(pairs, "block-pairs")
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 0.0001)))) + _MARGIN if threshold > 0.0001 else float("inf")  # a zero vector's cosine is 0
    used = pairs.filter(F.col("least") <= reach)
    found = _tiles(used, q, c).mapInPandas(score, "a bigint, b bigint, score double")
    return (found.distinct() if one else found), pairs, used


def duplication_candidates(parts: dict[str, DataFrame], decided: DataFrame | None = None) -> DataFrame:
    """One table (a, b, method, score, status) of all detected duplicates.

    Each part has columns a, b, score; ``decided`` gives the status of pairs already reviewed.
    """
    rows = [
        df.select(F.col("a"), F.col("b"), F.lit(m).alias("method"), F.col("score").cast("double").alias("score"))
        for m, df in parts.items()
    ]
    table = reduce(DataFrame.unionByName, rows)
    if decided is None:
        return table.withColumn("status", F.lit("open"))
    return table.join(decided.select("a", "b", "status"), ["a", "b"], "left").withColumn(
        "status", F.coalesce("status", F.lit("open"))
    )
