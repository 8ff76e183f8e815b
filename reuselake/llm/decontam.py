"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts become sequences of lower-case words; in scripts without blanks every character, with its marks, is a word.
A document leaks an item if some window of it is within ``EDITS`` of the item's length in word edits. Items of fewer than ``LEAST_WORDS``
words are allowed no edit and are found exactly, as phrases; the others as follows.
The CGK walk reads a sequence with a pointer that a shared random bit of (step, word) moves or leaves, and writes the word under
it at every step; few edits change few of the written symbols, because walks meet again. Each repetition has its own random bits and
samples some of the steps; a window and an item that agree in all sampled steps of a repetition are a candidate pair, and the pair is verified
by the exact edit distance of the item to the best window near it.

Items are a stated query set, taken in blocks of bounded size; documents are never shuffled: each batch is searched where it is
read. The number of repetitions is not guessed: ``fit_search`` edits every item at the allowed limit and adds repetitions until the target share of
those variants is found; where they are not enough, every window that can match is compared. Items longer than ``LONGEST_PART`` are searched by
their parts: of k edits over an item, some part has no more than its share. The whole item is verified. Windows that cannot match are left out beforehand without loss: a match within k edits of an item
of n words has n - k of the words of such items in its first n words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import aside, small_batches
from reuselake.llm.hashing import mix, salted

EDITS = 0.2
RECALL = 0.98
SAMPLED = 3
MOST_REPETITIONS = 400
#: Longer walks drift apart too often; longer items are cut.
LONGEST_PART = 64
#: Items that are searched together; more items make more passes.
BLOCK_ITEMS = 20_000
#: Items of fewer words are allowed no edit and need no search by sampling.
LEAST_WORDS = 5
#: Scripts without blanks: Thai to Myanmar, Khmer, Tai scripts, Balinese, kana and bopomofo, Han, Yi, Javanese.
NO_BLANKS = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in NO_BLANKS)
_MARKS = "".join(chr(c) for a, b in NO_BLANKS if b < 0x10000 for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "M")
WORD = re.compile(rf"[^\W_{_ALONE}]+|(?![\W_])[{_ALONE}][{_MARKS}]*")
RESULT = "array<struct<item_id:bigint,edits:int>>"


def allowed(words: int) -> int:
    return int(EDITS * words)


def _bits(words: int, steps: int, seed: int) -> np.ndarray:
    """The repetition's shared random bits of (step, word code)."""
    return salted(np.arange(steps * (words + 1)), seed).reshape(steps, words + 1) >> np.uint64(63) > 0


def _walk(code: np.ndarray, start: np.ndarray, length: int, steps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Hash of the symbols that the walk from each start writes at the sampled ``steps`` (sorted); windows end after ``length`` words."""
    at = start.copy()
    end = start + length
    key = np.zeros(len(start), np.uint64)
    sampled = set(steps.tolist())
    for step in range(int(steps[-1]) + 1):
        if step < length:  # one word a step at most
            symbol = code[at]
            move = bits[step][symbol]
        else:
            symbol = np.where(at < end, code[np.minimum(at, end - 1)], 0)
            move = bits[step][symbol] & (at < end)
        if step in sampled:
            key = mix(key + symbol.astype(np.uint64) + np.uint64(1))
        at += move
    return key


def edit_distance_near(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest edit distance of ``item`` to any run of ``text``."""
    row = np.arange(len(item) + 1)
    ramp = np.arange(len(item) + 1)
    best = row[-1]
    for symbol in text:
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + (item != symbol), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        best = min(best, row[-1])
    return int(best)


@dataclass
class Search:
    """Parts of one length class: code sequences, and for each repetition the sampled steps and the parts' keys."""

    length: int
    fewest: int  # words of the parts that a window of ``length`` must hold
    items: list[int]  # places in the index's parts
    words: int = 0
    exact: bool = False  # too many edited parts are missed: windows are compared without sampling
    seeds: list[int] = field(default_factory=list)
    steps: list[np.ndarray] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)  # sorted
    owner: list[np.ndarray] = field(default_factory=list)

    def local(self, index: Index) -> np.ndarray:
        """From word codes to codes of the words that items of this class hold; 0 for all others."""
        held = np.unique(np.concatenate([index.parts[i].sequence for i in self.items]))
        out = np.zeros(len(index.vocabulary) + 1, np.int64)
        out[held] = np.arange(1, len(held) + 1)
        self.words = len(held)
        return out


class Phrases:
    """Exact search for short sequences: a tree whose nodes at each depth are the sorted numbers parent * base + code."""

    def __init__(self, index: Index, items: list[int]):
        self.base = len(index.vocabulary) + 1
        self.levels: list[np.ndarray] = []
        self.owners: list[dict[int, list[int]]] = []  # per depth: items that end at a node
        node, depth = {i: 0 for i in items}, 0
        while node:
            value = {i: at * self.base + int(index.sequences[i][depth]) for i, at in node.items()}
            level = np.array(sorted(set(value.values())), np.int64)
            node = {i: int(np.searchsorted(level, v)) for i, v in value.items()}
            depth += 1
            owners: dict[int, list[int]] = {}
            for i, at in node.items():
                if len(index.sequences[i]) == depth:
                    owners.setdefault(at, []).append(i)
            self.levels.append(level)
            self.owners.append(owners)
            node = {i: at for i, at in node.items() if len(index.sequences[i]) > depth}

    def found(self, code: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item); unknown words between documents keep phrases within them."""
        out: set[tuple[int, int]] = set()
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for depth, (level, owners) in enumerate(zip(self.levels, self.owners, strict=True)):
            inside = at + depth < len(code)
            at, node = at[inside], node[inside]
            value = node * self.base + code[at + depth]
            place = np.minimum(np.searchsorted(level, value), len(level) - 1)
            same = level[place] == value
            at, node = at[same], place[same]
            doc = np.searchsorted(starts, at, "right") - 1
            ends = np.isin(node, np.fromiter(owners, np.int64, len(owners)))
            for d, k in np.unique(np.stack([doc[ends], node[ends]]), axis=1).T.tolist():
                out.update((d, i) for i in owners[k])
        return out


@dataclass
class Part:
    item: int
    offset: int
    sequence: np.ndarray


@dataclass
class Index:
    ids: list[int]
    sequences: list[np.ndarray]
    vocabulary: dict[str, int]
    classes: list[Search]
    phrases: Phrases | None = None
    parts: list[Part] = field(default_factory=list)

    def codes(self, text: str) -> np.ndarray:
        return np.fromiter((self.vocabulary.get(w, 0) for w in WORD.findall(text.lower())), np.int64)


def _edited(item: np.ndarray, edits: int, words: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out))) if out else 0
        symbol = int(rng.integers(words + 1))
        if kind == 0 and out:
            out[at] = symbol
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, symbol)
    return np.array(out, np.int64)


def fit_search(items: list[tuple[int, str]], recall: float = RECALL) -> Index:
    """Index of one block of items. Classes hold items whose lengths are within a tenth; windows have the shortest length of the class."""
    index = Index([], [], {}, [])
    for item_id, text in items:
        words = WORD.findall((text or "").lower())
        if words:
            index.ids.append(item_id)
            index.sequences.append(np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words], np.int64))
    index.phrases = Phrases(index, [i for i, s in enumerate(index.sequences) if len(s) < LEAST_WORDS])
    for i, s in enumerate(index.sequences):
        if len(s) >= LEAST_WORDS:
            at = 0
            for part in np.array_split(s, -(-len(s) // LONGEST_PART)):
                index.parts.append(Part(i, at, part))
                at += len(part)
    order = sorted(range(len(index.parts)), key=lambda i: len(index.parts[i].sequence))
    for i in order:
        n = len(index.parts[i].sequence)
        if not index.classes or n > 1.1 * index.classes[-1].length:
            index.classes.append(Search(n, n - allowed(n), []))
        own = index.classes[-1]
        own.items.append(i)
        # of an item longer than the window, words beyond the window cannot be counted
        own.fewest = min(own.fewest, own.length - allowed(n))
    for group in index.classes:
        _calibrate(group, index, recall)
    return index


def _calibrate(group: Search, index: Index, recall: float) -> None:
    rng, local = np.random.default_rng(1000 + group.length), group.local(index)
    variants, whose = [], []
    for i in group.items:
        part = index.parts[i].sequence
        for _ in range(max(2, 200 // len(group.items))):
            variants.append(_edited(part, allowed(len(part)), len(index.vocabulary), rng))
            whose.append(i)
    whose = np.array(whose)
    missed = np.ones(len(variants), bool)
    while missed.mean() > 1 - recall and len(group.seeds) < MOST_REPETITIONS:
        seed = len(group.seeds) + 1
        steps = np.sort(rng.choice(group.length, SAMPLED, replace=False))
        keys = _keys([local[index.parts[i].sequence] for i in group.items], group, steps, seed)
        mine = dict(zip(group.items, keys.tolist(), strict=True))
        got = _keys([local[v] for v in variants], group, steps, seed)
        missed &= got != np.array([mine[i] for i in whose.tolist()], np.uint64)
        order = np.argsort(keys)
        group.seeds.append(seed)
        group.steps.append(steps)
        group.keys.append(keys[order])
        group.owner.append(np.array(group.items)[order])
    group.exact = bool(missed.mean() > 1 - recall)


def _keys(sequences: list[np.ndarray], group: Search, steps: np.ndarray, seed: int) -> np.ndarray:
    """Key of the first words of each sequence; a shorter one is followed by unknown words."""
    rows = np.zeros((len(sequences), group.length), np.int64)
    for k, s in enumerate(sequences):
        rows[k, : min(group.length, len(s))] = s[: group.length]
    return _walk(rows.reshape(-1), np.arange(len(sequences)) * group.length, group.length, steps, _bits(group.words, int(steps[-1]) + 1, seed))


def find(index: Index, texts: list[str]) -> list[list[dict]]:
    """For each text the items it leaks, with the fewest word edits, in order of item_id."""
    codes = [index.codes(t) for t in texts]
    gap = max((g.length for g in index.classes), default=1)
    pad = np.zeros(gap, np.int64)
    code = np.concatenate([x for c in codes for x in (c, pad)]) if codes else pad
    starts = np.zeros(len(codes) + 1, np.int64)
    np.cumsum([len(c) + gap for c in codes], out=starts[1:])
    spans: dict[tuple[int, int], set[tuple[int, int]]] = {}

    def near(doc: int, part: Part, first: int, last: int) -> None:
        """The item may be around windows ``first`` to ``last``."""
        n = len(index.sequences[part.item])
        slack = allowed(n) * (2 if n > LONGEST_PART else 1)  # a part drifts as well
        low, high = max(int(starts[doc]), first - part.offset - slack), min(int(starts[doc + 1]) - gap, last - part.offset + n + 2 * allowed(n))
        if low < high:
            spans.setdefault((doc, part.item), set()).add((low, high))

    for group in index.classes:
        if len(code) < group.length:
            continue
        own = group.local(index)[code]
        known = own > 0
        held = np.append(0, np.cumsum(known))
        full = held[group.length :] - held[: len(held) - group.length]
        known = np.append(known, False)
        # a match may begin with a strange word; what is strange before that makes no better window
        window = np.nonzero((full >= group.fewest) & (known[:-1] | known[1:])[: len(full)])[0]
        if group.exact and len(window):
            doc = np.searchsorted(starts, window, "right") - 1
            for run in np.split(window, np.nonzero((np.diff(window) > group.length) | (np.diff(doc) > 0))[0] + 1):
                d = int(np.searchsorted(starts, run[0], "right")) - 1
                for i in group.items:
                    near(d, index.parts[i], int(run[0]), int(run[-1]))
            continue
        pairs: set[tuple[int, int]] = set()
        for seed, steps, keys, owner in zip(group.seeds, group.steps, group.keys, group.owner, strict=True):
            if not len(window):
                break
            got = _walk(own, window, group.length, steps, _bits(group.words, int(steps[-1]) + 1, seed))
            low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            for k in np.nonzero(high > low)[0]:
                pairs.update((int(i), int(window[k])) for i in owner[low[k] : high[k]])
        for i, at in pairs:
            near(int(np.searchsorted(starts, at, "right")) - 1, index.parts[i], at, at)
    best = dict.fromkeys(index.phrases.found(code, starts), 0)
    for (doc, i), places in spans.items():
        item = index.sequences[i]
        k = allowed(len(item))
        joined: list[list[int]] = []
        for low, high in sorted(places):
            if np.isin(item, code[low:high]).sum() < len(item) - k:  # too few of its words for so few edits
                continue
            if joined and low <= joined[-1][1]:  # one run of text is compared once
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        edits = min((edit_distance_near(item, code[low:high]) for low, high in joined), default=k + 1)
        if edits <= k:
            best[doc, i] = edits
    out: list[list[dict]] = [[] for _ in texts]
    for (doc, i), edits in best.items():
        out[doc].append({"item_id": index.ids[i], "edits": edits})
    return [sorted(x, key=lambda y: y["item_id"]) for x in out]


def item_blocks(items: DataFrame, block: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """Items with an id and a text, ``block`` at a time; of repeated rows one counts."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    held = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _searcher(index: Index):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for k in range(0, len(texts), 1000):
                found += find(index, [t or "" for t in texts.iloc[k : k + 1000]])
            yield pd.Series(found, dtype=object)

    return search


def with_leaks(docs: DataFrame, items: DataFrame, into: str = "_leaks") -> DataFrame:
    """Add the array ``into`` of (item_id, edits). A null or empty text leaks nothing; an item without a word (letter or digit) is in no text."""
    out = small_batches(docs).withColumn(into, F.array().cast(RESULT))
    for block in item_blocks(items):
        out = out.withColumn(into, F.concat(into, F.pandas_udf(_searcher(fit_search(block)), RESULT)("text")))
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item."""
    found = with_leaks(docs.select("doc_id", "text"), items).select("doc_id", F.explode("_leaks").alias("_l"))
    return found.select("doc_id", "_l.item_id", "_l.edits")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with the columns of ``docs`` whatever they are called."""
    named, back = aside(docs, "text")
    return back(with_leaks(named, items).where(F.size("_leaks") == 0))
