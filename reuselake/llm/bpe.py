"""BPE encoding and decoding over a table of distinct words.

Tokens never cross the pieces that the tokenizer's own pattern cuts (here called words), so each distinct word is encoded once:

1. documents are cut into words in chunks; a document becomes numbers of its chunk's distinct words (recomputed, not stored);
2. the distinct words of all chunks are dealt by word in packed rows, so that all uses of a word meet, and it is encoded once;
3. each chunk's table of word ids is joined back to its documents by number; ids are laid out by position.

Decoding looks each id up in the id-to-piece table, which is as large as the vocabulary, and joins pieces by one blank: that is
what the library does for a vocabulary file without decoder. Texts of code points below U+0300 are already in
composed form and are cut with numpy; others and those with special tokens go through the library's own normaliser and splitter.

What is shuffled is the documents' word numbers and one row per chunk and distinct word, not texts. The input must be read
from files (or come from ``stored``), because its rows are read twice in the same order; each chunk proves that by a checksum.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reuselake.llm.common import small_batches
from reuselake.llm.hashing import Rolling, distinct_spans

#: A chunk is what has a table of words of its own; a part is what numpy works on at once.
CHUNK_CHARS, PART_CHARS = 8_000_000, 1_000_000
#: Texts of lower code points are in composed form, lower-case letter by letter (but for U+0130) and need no normaliser.
SAFE_BELOW = 0x300
ENCODED = "doc_id long, ids array<int>, decoded string"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cutter:
    """Cuts texts into the pieces that the file's normaliser and pattern make."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        if steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"] or spec["decoder"] or not plain:
            raise ValueError("only word-end vocabularies with composed lower-case text are supported")
        pattern = split["pattern"]["Regex"]
        whole = Tokenizer.from_file(path)
        self.normal, self.whole = whole.normalizer, whole
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unsafe = regex.compile(f"[^\\x00-\\u012f\\u0131-\\u{SAFE_BELOW - 1:04x}]")  # U+0130 becomes two when lower
        kinds = ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"))
        self.kind = np.array([next((k for k, p in kinds if regex.match(p, chr(c))), _OTHER) for c in range(SAFE_BELOW)], np.uint8)
        # the pattern's endings after a single apostrophe
        self.endings = [e for e in ("s", "t", "re", "ve", "m", "ll", "d") if regex.fullmatch(pattern, "'" + e)]

    def slow(self, text: str) -> list[str]:
        """Pieces of one text; special tokens get a leading blank, which no other piece has."""
        out: list[str] = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(" " + part)
            elif part:
                out += [p for p, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def fast(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case joined text, symbols, begin and end of every piece, and each text's first piece (and the end)."""
        lower = [t.lower() for t in texts]
        joined = "\n".join(lower) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.zeros(len(lower) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in lower], out=starts[1:])
        kind = self.kind[code]
        first = np.empty(len(code), bool)
        first[:1] = True
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        begin = np.nonzero(first)[0]
        end = np.append(begin[1:], len(code))
        real = kind[begin] != _SPACE
        begin, end = begin[real], end[real]
        # an apostrophe alone before letters takes one of the endings with it
        lone = np.nonzero((code[begin] == ord("'")) & (end - begin == 1) & (np.append(begin[1:], -1) == end))[0]
        gone = np.zeros(len(begin), bool)
        for k in lone:
            at, stop = begin[k] + 1, end[k + 1]
            if kind[at] != _LETTER:
                continue
            ending = next((e for e in self.endings if joined.startswith(e, at)), None)
            if ending:
                end[k] = begin[k + 1] = at + len(ending)
                gone[k + 1] = end[k] == stop
        if gone.any():
            begin, end = begin[~gone], end[~gone]
        return joined, code, begin, end, np.searchsorted(begin, starts)

    def chunk(self, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
        """Distinct pieces, most frequent first, and each text as numbers of them."""
        hard = [bool(self.unsafe.search(t)) or any(s in t for s in self.special) for t in texts]
        hashes, pieces, numbers, ends, cuts = [], [], [], [0], np.zeros(1, np.int64)
        for part in _parts([t for t, h in zip(texts, hard, strict=True) if not h]):
            joined, code, begin, end, starts = self.fast(part)
            found, one, number = np.unique(distinct_spans(Rolling(code), code.view(np.uint8).data, begin, end, code.itemsize), return_index=True, return_inverse=True)
            hashes.append(found)
            pieces += [joined[b:e] for b, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
            numbers.append(number + ends[-1])
            ends.append(ends[-1] + len(found))
            cuts = np.append(cuts, cuts[-1] + starts[1:])
        # the parts' tables become one
        _, one, merged = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_index=True, return_inverse=True)
        pieces = [pieces[i] for i in one.tolist()]
        number = merged[np.concatenate([np.zeros(0, np.int64), *numbers])]
        count = np.bincount(number, minlength=len(pieces))
        if any(hard):
            known = {p: i for i, p in enumerate(pieces)}
            own = [np.array([known.setdefault(p, len(known)) for p in self.slow(t)], np.int64) for t, h in zip(texts, hard, strict=True) if h]
            pieces = list(known)
            count = np.append(count, np.zeros(len(pieces) - len(count), np.int64)) + np.bincount(np.concatenate(own), minlength=len(pieces))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        number = rank[number]
        out, slow, k = [], iter(own if any(hard) else ()), 0
        for h in hard:
            if h:
                out.append(rank[next(slow)])
            else:
                out.append(number[cuts[k] : cuts[k + 1]])
                k += 1
        return [pieces[i] for i in order], out

    def encoder(self):
        """Encoder of single pieces, without normaliser."""
        from tokenizers import Tokenizer, pre_tokenizers

        words = Tokenizer(self.whole.model)
        words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def encode(pieces: list[str]) -> list[list[int]]:
            plain = words.encode_batch_fast([p for p in pieces if p[0] != " "], add_special_tokens=False)
            ids = iter(plain)
            return [[self.special[p[1:]]] if p[0] == " " else next(ids).ids for p in pieces]

        return encode

    def pieces(self) -> list[str]:
        """The id-to-piece table."""
        table = {i: p for p, i in self.whole.get_vocab(with_added_tokens=True).items()}
        return [table.get(i, "") for i in range(max(table) + 1)]


@cache
def _cutter(path: str) -> Cutter:
    return Cutter(path)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, of about PART_CHARS together."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes (low bytes together), compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _zip(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[str]]]:
    """(chunk number, checksum of its rows, doc_ids, texts); a chunk ends once it has CHUNK_CHARS."""
    part, k, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    made = lambda: (part + k, zlib.crc32(repr((ids, [len(t) for t in texts])).encode()), ids, texts)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS:
                yield made()
                k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield made()


def _cut_words(path: str, buckets: int):
    """A chunk's distinct words, dealt by word; the words of one bucket are one packed row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, check, _, texts in _chunks(batches):
            words, _ = _cutter(path).chunk(texts)
            dealt: dict[int, list[tuple[str, int]]] = defaultdict(list)
            for no, w in enumerate(words):
                dealt[zlib.crc32(w.encode()) % buckets].append((w, no))
            del words, texts
            rows = [(k, *zip(*sorted(v), strict=True)) for k, v in dealt.items()]
            yield pa.record_batch({
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()), "check": pa.array([check] * len(rows), pa.int64()),
                "words": pa.array([_zip("\n".join(r[1]).encode()) for r in rows], pa.binary()),
                "nos": pa.array([_pack(np.array(r[2])) for r in rows], pa.binary()),
            })
    return cut


def _cut_documents(path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, check, ids, texts in _chunks(batches):
            _, numbers = _cutter(path).chunk(texts)
            yield pa.record_batch({
                "chunk": pa.array(np.full(len(ids), chunk)), "check": pa.array(np.full(len(ids), check, np.int64)),
                "doc_id": pa.array(ids, pa.int64()), "numbers": pa.array([_pack(n) for n in numbers], pa.binary()),
            })
    return cut


def _encode_buckets(path: str):
    """Rows sorted by bucket: a bucket's words meet here, and each distinct word is encoded once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, table = _cutter(path).encoder(), None, {}
        for batch in batches:
            sizes, ids = [], []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != last:
                    last, table = bucket, {}
                words = _unzip(packed).decode().split("\n")
                fresh = [w for w in words if w not in table]
                table.update(zip(fresh, run(fresh), strict=True))
                coded = [table[w] for w in words]
                sizes.append(_pack(np.array([len(x) for x in coded])))
                ids.append(_pack(np.array([i for x in coded for i in x])))
            yield pa.record_batch({
                "chunk": batch.column("chunk"), "check": batch.column("check"), "nos": batch.column("nos"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary()),
            })
    return encode


def _lay_out(path: str):
    def lay(docs: pa.Table, words: pa.Table) -> pa.Table:
        if len({*docs.column("check").to_pylist(), *words.column("check").to_pylist()}) > 1:
            raise RuntimeError("the input was read in another order the second time; pass stored(docs)")
        joined = lambda name: np.concatenate([np.zeros(0, np.uint32), *(_unpack(x) for x in words.column(name).to_pylist())]).astype(np.int64)
        nos, flat = joined("nos"), joined("ids").astype(np.int32)
        length, offset = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
        length[nos] = joined("sizes")
        offset[nos] = np.cumsum(length[nos]) - length[nos]
        piece = _cutter(path).pieces()
        pieces = [piece[i] for i in flat.tolist()]
        spelled = [" ".join(pieces[a : a + n]) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
        del pieces
        out_ids, out_text, sizes = [np.zeros(0, np.int32)], [], [0]
        for packed in docs.column("numbers").to_pylist():
            n = _unpack(packed)
            size = length[n]
            at = np.repeat(offset[n] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out_ids.append(flat[at])
            sizes.append(len(at))
            out_text.append(" ".join([spelled[i] for i in n.tolist() if length[i]]))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(out_ids)))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": lists, "decoded": pa.array(out_text, pa.string())})
    return lay


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (by the id-to-piece table) for every row of ``docs``.

    Null and empty texts give no ids and an empty decoded text. Other columns are ignored; repeated rows come out as often.
    """
    path = path or vocabulary()
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    words = rows.mapInArrow(_cut_words(path, 4 * parts), "bucket int, chunk long, check long, words binary, nos binary")
    encoded = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_buckets(path), "chunk long, check long, nos binary, sizes binary, ids binary")
    numbered = rows.mapInArrow(_cut_documents(path), "chunk long, check long, doc_id long, numbers binary")
    return numbered.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_lay_out(path), ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``text`` to rows with ``ids``: every id's piece from the id-to-piece table, joined by one blank. Null ids give a null text."""
    path = path or vocabulary()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _cutter(path).pieces()
        for b in batches:
            texts = [None if x is None else " ".join([piece[i] for i in x]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    names = [c for c in encoded.columns if c != "text"]
    kept = encoded.select(*names)
    return kept.mapInArrow(look_up, kept.select(*names, F.lit("").alias("text")).schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    out = encode(docs, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
