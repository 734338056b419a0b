"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document becomes its token ids and an end id. A document of more than ``capacity`` ids is cut
into pieces of exactly ``capacity``; what is left over is its first piece. Full pieces are
sequences of their own. The others are placed one by one, longest first, into the open sequence
where the sum over all gaps of the squared number of open sequences with that gap becomes smallest
(ties go to the smallest gap), and into a new one only where no open one has room: opening one
early, as the rule for endless streams does, took up to 3 % more. Placement needs lengths only and runs in groups of
``GROUP_ROWS`` documents, chosen by a hash, each in one task of bounded memory; a group leaves at
most a few sequences part filled, so splitting costs next to nothing.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each;
an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 1024, 2
GROUP_ROWS = 50_000
#: Pieces of text without a break longer than this go to the encoder that merges in n log n.
LONG_RUN = re.compile(r"\S{400,}|\s{400,}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE vocabulary file, the same as the tokenizers library gives.

    The rank file beside it holds the same vocabulary for a faster encoder, which takes every text
    without special tokens and without very long unbroken runs.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(vocabulary), None
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    return Encoder(vocabulary, ranks)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(documents: DataFrame, vocabulary: str, ranks: str | None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, before they are placed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each length, by the sum-of-squares rule, longest first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gap 0 is closed and doesn't count
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size == capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        fits = count[size:capacity] > 0
        if fits.any():
            # from gap g to g - size: the squares change by 1 - 2 count[g] and 1 + 2 count[g - size]
            change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
            change[0] = 1 - 2 * count[size]
            change[~fits] = np.iinfo(np.int64).max
            gap = size + int(change.argmin())
            bin_ = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_, made = capacity, made, made + 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > size:
            open_at[gap - size].append(bin_)
            count[gap - size] += 1
    return bins, offsets


def pack(documents: DataFrame, vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece with its sequence_id and the offset there."""
    if vocabulary is None:
        vocabulary, ranks = default_files()
    groups = max(1, round(documents.count() / group_rows))

    def placed(key, table):  # without hints, which Spark would have to know
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = place(table["length"].to_numpy(), capacity)
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 40))).append_column("offset", pa.array(offsets))

    cut = pieces(documents, vocabulary, ranks, capacity, end_id)
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(groups)).cast("long")
    return cut.withColumn("group", group).groupBy("group").applyInArrow(placed, PACKED)
