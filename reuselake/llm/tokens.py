"""Words of whole batches of texts, numbered exactly (by Arrow's dictionary, not by hashes) without per-word Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Kinds of bytes.
WORD, BLANK, BREAK = 0, 1, 2


def byte_kinds(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """Words of several texts in order: ``word`` indexes ``distinct``; ``text`` and ``piece`` say where a word stands (pieces never cross texts)."""

    word: np.ndarray
    distinct: list[bytes]
    text: np.ndarray
    piece: np.ndarray

    def windows(self, size: int, of: np.ndarray) -> np.ndarray:
        """Places at which ``size`` words in a row have the same value of ``of`` (``text`` or ``piece``)."""
        n = len(of) - size + 1
        return np.nonzero(of[:n] == of[size - 1 :])[0] if n > 0 else np.zeros(0, np.int64)


def split(texts: list[bytes], kinds: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """``fold`` maps bytes (such as A-Z to a-z) before splitting."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    if fold is not None:
        joined = fold[joined]
    kind = kinds[joined]
    kind[ends - 1] = BREAK
    inside = kind == WORD
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    letters = np.ascontiguousarray(joined[inside])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    breaks = np.nonzero(kind == BREAK)[0]
    return Words(coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.searchsorted(ends, begin, "right").astype(np.int32), np.searchsorted(breaks, begin).astype(np.int32))


def chunks(texts: Iterable, most_bytes: int) -> Iterator[list[int]]:
    """Numbers of texts (byte strings) in order, about ``most_bytes`` together; a longer text stands alone."""
    chunk, size = [], 0
    for i, t in enumerate(texts):
        chunk.append(i)
        size += len(t)
        if size >= most_bytes:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk
