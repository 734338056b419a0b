"""Words of Arrow texts and their hashes, a block of texts at a time, in numpy.

Words are maximal runs of bytes other than ASCII white space (0x20 and 0x09 to 0x0D). Hashes have 64
bits and are the same in every process. A run of words is hashed from prefix sums, so that any range
costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; an Arrow batch is taken in slices of about so many.
BLOCK_BYTES = 2_000_000
SPACES = [0x20, *range(0x09, 0x0E)]
IS_WORD = np.ones(256, bool)
IS_WORD[SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    if len(_powers.get(base, ())) <= n:
        grown = np.full(max(n + 1, 1024), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return _powers[base]


@dataclass
class Words:
    """The words of a block of texts: doc_at[d] to doc_at[d + 1] are those of text d."""

    hashes: np.ndarray
    doc_at: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_at) - 1), np.diff(self.doc_at))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of texts without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    doc_at = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.empty(0, np.uint64), doc_at)
    letters = data[word]
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    values = BYTE_VALUES[LOWER[letters] if lower else letters]
    values *= powers(int(BASES[2]), int(lengths.max()))[place]
    return Words(mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), doc_at)


class RangeHash:
    """Hashes of any ranges of words, in one of two independent ways."""

    def __init__(self, hashes: np.ndarray, way: int):
        base = int(BASES[way])
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n)[:n], out=self.sums[1:])
        self.back = powers(pow(base, -1, 2**64), n)
        self.salt = BASES[1 - way]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * self.salt)


def blocks(table: pa.Table | pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(table.column(table.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def to_blob(columns: dict[str, np.ndarray]) -> bytes:
    """Arrays of one length as bytes; names and kinds are agreed on by both sides."""
    n = len(next(iter(columns.values())))
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())


def from_blobs(blobs: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The arrays of many blobs, one after the other."""
    parts: dict[str, list[np.ndarray]] = {k: [np.empty(0, t)] for k, t in kinds.items()}
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for name, kind in kinds.items():
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) for k, v in parts.items()}


def dealt(columns: dict[str, np.ndarray], to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, blob) for each number in ``to``, with its rows in their order."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
    moved = {k: v[order] for k, v in columns.items()}
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(to[a]), to_blob({k: v[a:b] for k, v in moved.items()})


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """The partition number of documents; ``part_column`` is the same in Spark."""
    return (doc ^ (doc >> 15) ^ (doc >> 31)) % parts


def part_column(doc: str, parts: int):
    from pyspark.sql import functions as F

    c = F.col(doc)
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 15)).bitwiseXOR(F.shiftright(c, 31)), F.lit(parts)).cast("int")
