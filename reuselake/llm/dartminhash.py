"""MinHash near-duplicates with DartMinHash signatures.

An element's region is [0, weight). On every unit of it darts land as a Poisson process in time whose arrivals are hashed from
(element, unit, number), so equal regions receive equal darts in every document. A dart has a time, a coordinate of the signature and, for
real weights, a place within its unit. Each coordinate keeps its earliest dart; two signatures agree in a coordinate with the
weighted Jaccard similarity. Darts are thrown up to a time that fills all coordinates on average, about ``k log k`` of them
whatever the document's length, and further where a coordinate stays empty.

Elements are five-word shingles (words are runs without white space), weights are their counts. Signatures are cut
into bands; documents that share a band are candidates. Nothing is decided by signatures alone: candidates are verified by exact weighted Jaccard.

Bands never emit all pairs. Each band's members are compared with its smallest member (star); verified links make components. Bands whose
members still lie in several components get other, hashed centres for two more rounds. Members that are still apart then meet on their rarest
elements (two sets of similarity t share one of each one's n - ceil(t n) + 1 rarest). Elements that only one component holds cannot be
shared with another and count as rarest of all, so a text with more than 1 - t of them, such as one that has a common passage
and a rest of its own, is out without a comparison. At similarity 0.8, 32 bands of 5 miss a pair with probability 4e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import aside, small_batches, stored
from reuselake.llm.hashing import mix, salted, words_of
from reuselake.operators.graph import connected_components

SHINGLE = 5
BANDS, ROWS = 32, 5
SIMILARITY = 0.8
#: Texts of about so many bytes are worked on together (a longer text alone).
PIECE_BYTES = 1_000_000


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, owners: int, k: int) -> np.ndarray:
    """(owners, k) dart ids, the earliest dart of each coordinate. ``owner`` is sorted; every owner has weight above 0."""
    units = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(owner)), units)
    unit = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
    region = mix(element[row] + mix(unit))
    share = np.minimum(weight[row] - unit, 1.0)  # of the unit that lies in the region
    whose = owner[row]
    until = k * (np.log(k) + 3) / np.bincount(owner, weight, owners)
    out = np.zeros((owners, k), np.uint64)
    left = np.ones(owners, bool)
    while left.any():
        use = np.nonzero(left[whose])[0]
        time, cells, times, ids, n = np.zeros(len(use)), [], [], [], 0
        while len(use):
            dart = salted(region[use], 2 * n + 1)
            time = time - np.log1p(-(dart >> np.uint64(11)).astype(float) * 2.0**-53)
            live = time <= until[whose[use]]
            use, time, dart = use[live], time[live], dart[live]
            where = salted(dart, 7)
            hit = (where >> np.uint64(40)).astype(float) * 2.0**-24 < share[use]
            cells.append((whose[use] * k + (where & np.uint64(0xFFFFFFFF)).astype(np.int64) % k)[hit])
            times.append(time[hit])
            ids.append(dart[hit])
            n += 1
        cell, t, d = np.concatenate(cells), np.concatenate(times), np.concatenate(ids)
        late_first = np.argsort(-t)  # so the earliest dart of a coordinate is written last
        earliest, seen = np.zeros(owners * k, np.uint64), np.zeros(owners * k, bool)
        earliest[cell[late_first]] = d[late_first]
        seen[cell] = True
        filled = left & seen.reshape(owners, k).all(1)
        out[filled] = earliest.reshape(owners, k)[filled]
        left &= ~filled
        until = np.where(left, 2 * until, until)
    return out


def shingles(words: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every shingle; a text of fewer words has one shingle of all its words, one without words none."""
    counts = np.diff(starts)
    kept = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), kept)
    at = np.repeat(starts[:-1] - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
    last = starts[1:][owner]
    value = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(size, np.uint64))
    for i in range(size):
        value = mix(value + np.where(at + i < last, padded[at + i], np.uint64(i + 1)))
    return owner, value


def _counted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.nonzero(new)[0]
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def _pieces(texts: pd.Series) -> Iterator[list[bytes]]:
    piece, size = [], 0
    for t in texts:
        piece.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(piece[-1])
        if size >= PIECE_BYTES:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _keys(words: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """128-bit key of each text's word sequence: two sums of hashes that depend on word and place. None without words."""
    place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    halves = []
    for salt in (11, 12):
        sums = np.append(np.uint64(0), np.cumsum(salted(words + salted(place, salt), salt)))
        halves.append((sums[starts[1:]] - sums[starts[:-1]]).tolist())
    return [x.to_bytes(8, "big") + y.to_bytes(8, "big") if n else None for x, y, n in zip(*halves, np.diff(starts), strict=True)]


def _signed(texts: list[bytes]) -> pd.DataFrame:
    words, starts = words_of(texts)
    owner, element, weight = _counted(*shingles(words, starts))
    have, owner = np.unique(owner, return_inverse=True)
    bands: list = [None] * len(texts)
    if len(have):
        signature = dart_signatures(owner, element, weight.astype(float), len(have), BANDS * ROWS).reshape(len(have), BANDS, ROWS)
        value = np.broadcast_to(mix(np.arange(BANDS) + 1), (len(have), BANDS))
        for r in range(ROWS):
            value = mix(value + signature[:, :, r])
        for i, v in zip(have.tolist(), value.view(np.int64), strict=True):
            bands[i] = v
    return pd.DataFrame({"node": _keys(words, starts), "bands": bands})


def _sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        parts = [_signed(p) for p in _pieces(texts)]
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"node": [], "bands": []})


def _elements(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Set form of the weighted shingles: the i-th occurrence of a shingle is an element of its own."""
    for texts in batches:
        out = []
        for piece in _pieces(texts):
            words, starts = words_of(piece)
            owner, value, count = _counted(*shingles(words, starts))
            row = np.repeat(np.arange(len(owner)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            every = mix(value[row] + mix(nth)).view(np.int64)
            out += np.split(every, np.searchsorted(owner[row], np.arange(1, len(piece))))
        yield pd.Series(out)


def _verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """(a, b) with their exact weighted Jaccard similarity ``s``."""
    one = elements.select(F.col("node").alias("a"), F.col("elements").alias("_a"))
    two = elements.select(F.col("node").alias("b"), F.col("elements").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    # the distinct a (many) carry their arrays to b
    return pairs.join(one, "a").join(two, "b").select("a", "b", (both / (F.size("_a") + F.size("_b") - both)).alias("s"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of documents whose five-word shingles are ``similarity`` alike, directly or through others.

    One row per row of ``docs``: doc_id, node (key of the word sequence; null without words), class_node, class_id (smallest doc_id of the
    class). Texts of the same words are one node. Texts without words (null, empty, blank) are in no class: node null, class_id their own doc_id.
    Documents of fewer than five words have one shingle. A null doc_id is larger than all others.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = stored(rows.withColumn("_s", F.pandas_udf(_sign, "node binary, bands array<bigint>")("text")).select("doc_id", "_s.node", "_s.bands"), "darts")
    nodes = members.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    banded = stored(nodes.select("node", F.explode("bands").alias("band")), "bands")
    centres = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    spokes = stored(banded.join(centres, "band"), "spokes")  # every member of every shared band

    star = spokes.where("node <> centre").groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared"))
    star = stored(star, "stars")
    elements = stored(_candidate_elements(rows, spokes), "elements")
    # first each member's likeliest centre, then only what is not connected yet
    first = star.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    done = stored(_verified(first, elements), "first-links")
    label = stored(connected_components(done.where(F.col("s") >= similarity).select("a", "b")), "first-components")
    open_ = star.join(first, ["a", "b"], "left_anti")
    open_ = _labelled(_labelled(open_, label, "a"), label, "b").where("cluster_a <> cluster_b").select("a", "b")
    done = stored(done.unionByName(_verified(open_, elements)), "star-links")

    for turn in (1, 2):
        label = stored(connected_components(done.where(F.col("s") >= similarity).select("a", "b")), "components")
        more = _other_centres(_mixed(spokes, label), turn).join(done, ["a", "b"], "left_anti")
        done = stored(done.unionByName(_verified(more, elements)), "links")
    links = done.where(F.col("s") >= similarity).select("a", "b")
    label = stored(connected_components(links), "components")
    rest = stored(_rest(_mixed(spokes, label), done, elements, similarity), "rest")
    links = links.unionByName(_verified(rest, elements).where(F.col("s") >= similarity).select("a", "b"))
    label = connected_components(links).withColumnRenamed("cluster", "class_node")

    placed = members.select("doc_id", "node").join(label, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    smallest = placed.where("class_node is not null").groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return placed.join(smallest, "class_node", "left").select(
        "doc_id", "node", "class_node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
    )


def _candidate_elements(rows: DataFrame, spokes: DataFrame) -> DataFrame:
    """Elements of the nodes that share a band, from one text each."""
    wanted = spokes.select("node").distinct()
    texts = rows.withColumn("node", F.pandas_udf(_sign_node, "binary")("text")).join(wanted, "node", "left_semi")
    return texts.groupBy("node").agg(F.min("text").alias("text")).select("node", F.pandas_udf(_elements, "array<bigint>")("text").alias("elements"))


def _sign_node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out: list = []
        for piece in _pieces(texts):
            out += _keys(*words_of(piece))
        yield pd.Series(out, dtype=object)


def _labelled(pairs: DataFrame, label: DataFrame, side: str) -> DataFrame:
    found = label.select(F.col("node").alias(side), F.col("cluster").alias(f"_{side}"))
    return pairs.join(found, side, "left").withColumn(f"cluster_{side}", F.coalesce(f"_{side}", side)).drop(f"_{side}")


def _mixed(spokes: DataFrame, label: DataFrame) -> DataFrame:
    """Members (band, centre, node, cluster) of bands with several components, with the component that has most of the band."""
    placed = _labelled(spokes.withColumnRenamed("node", "a"), label, "a").withColumnsRenamed({"a": "node", "cluster_a": "cluster"})
    parts = placed.groupBy("band", "cluster").agg(F.count("*").alias("_n"))
    bands = parts.groupBy("band").agg(F.count("*").alias("_parts"), F.max_by("cluster", F.struct("_n", "cluster")).alias("main")).where("_parts > 1")
    return placed.join(bands.select("band", "main"), "band")


def _other_centres(mixed: DataFrame, turn: int) -> DataFrame:
    """Members of other components beside a hashed centre of their band."""
    centre = mixed.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "cluster")).alias("_c"))
    pairs = mixed.join(centre, "band").where(F.col("cluster") != F.col("_c.cluster"))
    return pairs.select(F.col("node").alias("a"), F.col("_c.node").alias("b")).distinct()


def _rest(mixed: DataFrame, done: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components, one of them outside its band's largest, that were not compared and share one of their rarest elements."""
    nodes = mixed.groupBy("node").agg(F.min("cluster").alias("cluster"), F.max(F.col("cluster") != F.col("main")).alias("out"))
    nodes = nodes.withColumn("part", F.xxhash64("cluster"))
    items = elements.join(nodes, "node").select("node", "part", "out", F.size("elements").alias("n"), F.explode("elements").alias("h"))
    shared = items.groupBy("h").agg(F.count("*").alias("f"), F.min("part").alias("_x"), F.max("part").alias("_y"), F.max("out").alias("_out")).where("_out and _x <> _y")
    rare = items.join(shared.select("h", "f"), "h").groupBy("node", "part", "out", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("sorted"))
    rare = rare.withColumn("e", F.size("sorted"))
    length = (F.col("e") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).cast("int")
    head = rare.where(length > 0).select("node", "part", "out", "n", "e", F.explode(F.slice("sorted", F.lit(1), length)).alias("_h")).withColumn("h", F.col("_h.h")).drop("_h")
    one = head.where("out").select("h", F.col("node").alias("a"), F.col("n").alias("_na"), F.col("e").alias("_ea"), F.col("part").alias("_pa"))
    two = head.select("h", F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("e").alias("_eb"), F.col("part").alias("_pb"), F.col("out").alias("_out"))
    enough = F.least("_ea", "_eb") >= similarity / (1 + similarity) * (F.col("_na") + F.col("_nb")) - 1e-9
    pairs = one.join(two, "h").where((F.col("_pa") != F.col("_pb")) & enough & (~F.col("_out") | (F.col("a") < F.col("b"))))
    return pairs.select("a", "b").distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "class_rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near copies: of each class the rows of its smallest doc_id and its node stay.

    Rows that repeat one document (same doc_id, same words) are one document and share its fate. Texts without words all stay.
    """
    found = near_duplicates(docs)
    best = found.where("node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")).alias("_best"))
    gone = found.where("node is not null").join(best, "class_node").where(~(F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("node") == F.col("_best.node"))))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct()
    named, back = aside(docs, "doc_id", "text")
    marked = named.withColumn("_node", F.pandas_udf(_sign_node, "binary")("text"))
    return back(marked.join(gone, F.col("_node").eqNullSafe(F.col("_gone_node")) & F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left_anti"))
