"""Substring dedup by a relative Lempel-Ziv parse against every indexed reference block.

Each text is cut, by its content alone, into overlapping reference blocks: of every window of
``WINDOW`` words the ``GRAM`` words with the smallest hash are its anchor, and a block is all words
of the consecutive windows that share an anchor. Equal windows have equal anchors wherever they
stand. The index holds, for each distinct block, where it starts first (document, then word); it is
spread over partitions by the anchor's hash. A block that starts earlier too is told two such places,
the first one and the last before it; where only some of its windows may (the index has its anchor
with other words around it), these are looked up one by one against all such blocks.

The parse goes through a document from left to right. Where the window at hand is known to start
earlier, a factor begins: it copies along one line, that is from one document at one distance, and is
extended over the blocks and windows that follow for as long as one of their places lies on that line;
of the lines at hand the one that reaches farthest is taken. The next factor begins at the first
window beyond, one that crosses the boundary, so no window between two factors is missed. Every
factor is ``WINDOW`` words or longer; the words in factors are the duplicate spans and are removed.

What moves: one small entry for each distinct block of a map batch (about a sixth of the words),
the answers, the windows at boundaries, and the texts once, dealt by document into parts of about
``TASK_BYTES``. A block that many documents share is one entry for each batch; an anchor that stands in
more than ``MANY`` different blocks of a batch is dealt by block, so one task gets at most ``MANY`` entries of an
anchor from each batch. Words are told apart by 64-bit hashes and runs of them by 128 bits over these.

Defined results: a null or empty text has no words; texts shorter than a window keep all words;
texts of any length are parsed whole; rows with the same doc_id count as one document in order of
places: a window of one goes where the words start earlier in a row of that id or of a smaller one, and
neither loses words to the other at the same place; rows without doc_id are neither indexed nor cut; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import parts_for, stage
from . import grams

WINDOW, GRAM = 20, 10
#: Different blocks around one anchor in a batch, above which they are dealt by block.
MANY = 8
#: Blocks gathered before they are dealt out.
FLUSH = 400_000
NORMAL, SPREAD, MARKER = range(3)
COPIED, CHECK, COPIED_WINDOW = range(3)
ENTRY = {"anchor": "u8", "around": "u8", "doc": "i8", "start": "i4", "flag": "u1"}
REFERENCES = {"ref_doc": "i8", "ref_start": "i4", "last_doc": "i8", "last_start": "i4"}
ANSWER = {"doc": "i8", "start": "i4", "content": "u8", "what": "u1"} | REFERENCES
WINDOWS = {"hash": "u8", "other": "u8", "doc": "i8", "start": "i4"}
FACTOR = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"
OUT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors {FACTOR}"


class Blocks:
    """The reference blocks of a slice of texts, in order."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        words = grams.split_words(texts)
        self.words, n = words, len(words.hashes)
        self.one, self.two = grams.RangeHash(words.hashes, 0), grams.RangeHash(words.hashes, 1)
        self.window = window
        doc_of = words.doc_of()
        windows = max(0, n - window + 1)
        at = np.arange(windows)
        inside = words.doc_at[doc_of[:windows] + 1] >= at + window
        least = np.zeros(windows, np.int64)
        if windows:
            hashes = self.one(np.arange(n - gram + 1), np.arange(gram, n + 1))
            best = hashes[:windows].copy()
            for k in range(1, window - gram + 1):
                lower = hashes[k : k + windows] < best
                best[lower] = hashes[k : k + windows][lower]
                least[lower] = k
        at = at[inside]
        anchors = at + least[inside]
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        self.anchor_at = anchors[first]
        self.start, self.stop = at[first], at[last]  # the first and the last window's start
        self.doc = doc_of[self.start] if len(first) else np.empty(0, np.int64)
        self.start_in_doc = (self.start - words.doc_at[self.doc]).astype(np.int32)
        self.anchor = self.one(self.anchor_at, self.anchor_at + gram)
        self.around = grams.mix(self.two(self.start, self.stop + window) + (self.anchor_at - self.start).astype(np.uint64))


def group_first(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, the place of the first row that has the same ones."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def answers(found: dict[str, np.ndarray], chosen: np.ndarray, what: int, first: np.ndarray, content: str = "around") -> dict[str, np.ndarray]:
    """What chosen rows are told: of sorted rows that are equal, the first one's place and the last one's before.

    ``content`` goes along, since rows that share a doc_id may hold different words at one place.
    """
    at = np.flatnonzero(chosen)
    last = np.maximum(at - 1, 0)
    itself = (found["doc"][last] == found["doc"][at]) & (found["start"][last] == found["start"][at])
    last = np.where(itself | (last < first[at]), first[at], last)
    ref = {"ref": first[at], "last": last}
    return {"doc": found["doc"][at], "start": found["start"][at].astype("i4"), "content": found[content][at], "what": np.full(len(at), what, "u1")} | {f"{k}_{c}": found[c][ref[k]].astype(ANSWER[f"{k}_{c}"]) for k in ref for c in ("doc", "start")}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def rows(pairs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array([p[2] for p in pairs], pa.binary())], ["to", "kind", "blob"])


ROWS = "to int, kind int, blob binary"


def settle(found: dict[str, np.ndarray], buckets: int, parts: int) -> list[tuple[int, int, bytes]]:
    """What a batch's blocks send: entries to their buckets, and answers that the batch knows itself."""
    order = np.lexsort((found["start"], found["doc"], found["around"], found["anchor"]))
    found = {k: v[order] for k, v in found.items()}
    first = group_first(found["anchor"], found["around"])
    own = first == np.arange(len(first))
    copies = ~own & ((found["doc"] != found["doc"][first]) | (found["start"] != found["start"][first]))
    known = answers(found, copies, COPIED, first)
    sent = {k: v[own] for k, v in found.items()}
    head = group_first(sent["anchor"])
    many = np.bincount(head, minlength=len(head))[head] > MANY if len(head) else np.empty(0, bool)
    sent["flag"] = np.where(many, SPREAD, NORMAL).astype("u1")
    marks = many & (head == np.arange(len(head)))
    marker = {k: v[marks] for k, v in sent.items()}
    marker["flag"] = np.full(marks.sum(), MARKER, "u1")
    all_sent = joined([sent, marker])
    key = np.where(all_sent["flag"] == SPREAD, grams.mix(all_sent["anchor"] ^ all_sent["around"]), all_sent["anchor"])
    out = [(b, 0, blob) for b, blob in grams.dealt(all_sent, ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))]
    return out + [(p, 1, blob) for p, blob in grams.dealt(known, grams.part_of(known["doc"], parts))]


def index_entries(documents: DataFrame, n: int, window: int, gram: int) -> DataFrame:
    """Entries for buckets (kind 0) and answers for documents (kind 1) of every batch."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in grams.blocks(batch):
                x = Blocks(texts.slice(a, b - a), window, gram)
                held.append({"anchor": x.anchor, "around": x.around, "doc": ids[a:b][x.doc], "start": x.start_in_doc})
                if sum(len(h["doc"]) for h in held) >= FLUSH:
                    yield rows(settle(joined(held), n, n))
                    held = []
        if held:
            yield rows(settle(joined(held), n, n))

    return documents.mapInArrow(entries, ROWS)


def answer_blocks(table: pa.Table, n: int) -> pa.Table:
    """One bucket of the index: which blocks are copies, and which need a check by window."""
    out = [(p, 1, blob) for p, k, blob in zip(*(table[c].to_pylist() for c in ("to", "kind", "blob")), strict=True) if k == 1]
    e = grams.from_blobs([blob for k, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == 0], ENTRY)
    marked = np.unique(e["anchor"][e["flag"] == MARKER])
    e = {k: v[e["flag"] != MARKER] for k, v in e.items()}
    order = np.lexsort((e["start"], e["doc"], e["around"], e["anchor"], e["flag"]))
    e = {k: v[order] for k, v in e.items()}
    first = group_first(e["flag"], e["anchor"], e["around"])
    own = first == np.arange(len(first))
    copies = ~own & ((e["doc"] != e["doc"][first]) | (e["start"] != e["start"][first]))
    head = group_first(e["flag"], e["anchor"])
    kinds = np.bincount(head, weights=own, minlength=len(head))[head] if len(head) else np.empty(0)
    check = own & ((kinds > 1) | (e["flag"] == SPREAD) | np.isin(e["anchor"], marked))
    told = joined([answers(e, copies, COPIED, first), answers(e, check, CHECK, first)])
    return pa.Table.from_batches([rows(out + [(p, 1, blob) for p, blob in grams.dealt(told, grams.part_of(told["doc"], n))])])


def settle_windows(found: dict[str, np.ndarray], buckets: int, parts: int) -> list[tuple[int, int, bytes]]:
    """The first window of each kind goes to its bucket, the others are known to be copies."""
    known, own = split_windows(found)
    out = [(b, 0, blob) for b, blob in grams.dealt(own, ((own["hash"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))]
    return out + [(p, 1, blob) for p, blob in grams.dealt(known, grams.part_of(known["doc"], parts))]


def split_windows(found: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Answers for the windows that start earlier too, and the other windows."""
    order = np.lexsort((found["start"], found["doc"], found["other"], found["hash"]))
    found = {k: found[k][order] for k in WINDOWS}
    first = group_first(found["hash"], found["other"])
    own = first == np.arange(len(first))
    copies = ~own & ((found["doc"] != found["doc"][first]) | (found["start"] != found["start"][first]))
    return answers(found, copies, COPIED_WINDOW, first, "hash"), {k: v[own] for k, v in found.items()}


def answer_windows(table: pa.Table, n: int) -> pa.Table:
    out = [(p, 1, blob) for p, k, blob in zip(*(table[c].to_pylist() for c in ("to", "kind", "blob")), strict=True) if k == 1]
    told, _ = split_windows(grams.from_blobs([blob for k, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == 0], WINDOWS))
    return pa.Table.from_batches([rows(out + [(p, 1, blob) for p, blob in grams.dealt(told, grams.part_of(told["doc"], n))])])


class Told:
    """Answers of one partition, looked up by document, start and content."""

    def __init__(self, table: pa.Table, what: tuple[int, ...]):
        a = grams.from_blobs(table["blob"].to_pylist(), ANSWER)
        a = {k: v[np.isin(a["what"], what)] for k, v in a.items()}
        key = self.key_of(a["doc"], a["start"], a["content"])
        order = np.argsort(key, kind="stable")
        self.key, self.a = key[order], {k: v[order] for k, v in a.items()}

    @staticmethod
    def key_of(doc: np.ndarray, start: np.ndarray, content: np.ndarray) -> np.ndarray:
        return grams.mix(grams.mix(grams.mix(doc.astype(np.int64).view(np.uint64)) + start.astype(np.uint64)) ^ content)

    def find(self, doc: np.ndarray, start: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have an answer, and the answers' places."""
        if not len(self.key) or not len(doc):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = self.key_of(doc, start, content)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        a = self.a
        hit = np.flatnonzero((self.key[place] == key) & (a["doc"][place] == doc) & (a["start"][place] == start) & (a["content"][place] == content))
        return hit, place[hit]


def boundary_windows(docs: pa.Table, told: pa.Table, n: int, window: int, gram: int) -> pa.Table:
    """The windows of blocks that need a check, for their buckets."""
    lookup, held = Told(told, (CHECK,)), []
    if len(lookup.key):
        for a, b in grams.blocks(docs):
            x = Blocks(docs["text"].slice(a, b - a), window, gram)
            ids = docs["doc_id"].slice(a, b - a).to_numpy()
            hit, _ = lookup.find(ids[x.doc], x.start_in_doc, x.around)
            count = x.stop[hit] - x.start[hit] + 1
            starts = np.repeat(x.start[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            doc = np.repeat(x.doc[hit], count)
            held.append({"hash": x.one(starts, starts + window), "other": x.two(starts, starts + window), "doc": ids[doc], "start": (starts - x.words.doc_at[doc]).astype("i4")})
    return pa.Table.from_batches([rows(settle_windows(joined(held), n, n) if held else [])])


def factorize(start: np.ndarray, stop: np.ndarray, doc: np.ndarray, lines: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Greedy factors of pieces in order: (first piece, last piece, line).

    A piece holds the windows from start to stop of a document, and copies along either of two lines.
    """
    joins = np.zeros(len(start), bool)
    joins[1:] = (start[1:] == stop[:-1] + 1) & (doc[1:] == doc[:-1])
    same = joins.copy()
    same[1:] &= (lines[0][1:] == lines[0][:-1]) & (lines[1][1:] == lines[1][:-1])
    heads = np.flatnonzero(~same)  # runs of pieces that offer the same lines are one step of the walk
    one, two, on = lines[0][heads].tolist(), lines[1][heads].tolist(), joins[heads].tolist()
    last = [*(heads[1:] - 1).tolist(), len(start) - 1]

    def reach(at: int, line: int) -> int:
        while at + 1 < len(one) and on[at + 1] and line in (one[at + 1], two[at + 1]):
            at += 1
        return at

    out, at = [], 0
    while at < len(one):
        to, line = reach(at, one[at]), one[at]
        if two[at] != line and (other := reach(at, two[at])) > to:
            to, line = other, two[at]
        out.append((int(heads[at]), last[to], line))
        at = to + 1
    return out


def parse(docs: pa.Table, told: pa.Table, window: int, gram: int) -> pa.Table:
    """Factors and what is kept of each document of a partition."""
    blocks_told, windows_told = Told(told, (COPIED,)), Told(told, (COPIED_WINDOW,))
    out: list[tuple] = []
    for a, b in grams.blocks(docs):
        texts = docs["text"].slice(a, b - a)
        x = Blocks(texts, window, gram)
        raw = docs["doc_id"].slice(a, b - a).to_pylist()
        ids = np.array([-1 if i is None else i for i in raw], np.int64)
        named = np.array([i is not None for i in raw], bool)
        hit, place = blocks_told.find(ids[x.doc], x.start_in_doc, x.around)
        pieces = [(x.start[hit], x.stop[hit], *(blocks_told.a[c][place] for c in REFERENCES))]
        doc_of = x.words.doc_of()
        if len(windows_told.key):
            starts = np.arange(max(0, len(doc_of) - window + 1))
            here = doc_of[: len(starts)]
            hit, place = windows_told.find(ids[here], starts - x.words.doc_at[here], x.one(starts, starts + window))
            pieces.append((starts[hit], starts[hit], *(windows_told.a[c][place] for c in REFERENCES)))
        start, stop, *refs = (np.concatenate(c) for c in zip(*pieces, strict=True))
        real = named[doc_of[start]] if len(start) else np.empty(0, bool)
        order = np.argsort(start[real], kind="stable")
        start, stop, *refs = (c[real][order] for c in (start, stop, *refs))
        doc = doc_of[start] if len(start) else start
        begins = x.words.doc_at[doc]
        # a line is a document to copy from and the distance to it
        line_of = np.concatenate([np.column_stack([refs[k], refs[k + 1] - (start - begins)]) for k in (0, 2)])
        known_lines, number = np.unique(line_of, axis=0, return_inverse=True)
        number = number.ravel()
        factors: dict[int, list] = {}
        depth = np.zeros(len(doc_of) + 1, np.int64)
        for first, last, line in factorize(start, stop, doc, (number[: len(start)], number[len(start) :])):
            at, end, d = int(start[first]), int(stop[last]) + window, int(doc[first])
            depth[at] += 1
            depth[end] -= 1
            ref_doc, shift = known_lines[line].tolist()
            own = at - int(begins[first])
            factors.setdefault(d, []).append({"start": own, "length": end - at, "ref_doc": ref_doc, "ref_start": own + shift})
        removed = np.cumsum(depth[:-1]) > 0
        for d, text in enumerate(texts):
            lo, hi = x.words.doc_at[d], x.words.doc_at[d + 1]
            words = text.as_py().encode().split()
            gone = removed[lo:hi]
            cut = int(gone.sum())
            kept = b" ".join(compress(words, (~gone).tolist()) if cut else words)
            out.append((raw[d], len(words), cut, hashlib.sha256(kept).hexdigest(), factors.get(d, [])))
    columns = list(zip(*out, strict=True)) or [()] * 5
    factor = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), factor), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256, factors (start, length, ref_doc, ref_start)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = parts_for(docs, "text")
    named = docs.where(F.col("doc_id").isNotNull())
    told = index_entries(named, n, window, gram).repartition(n, "to").groupBy("to").applyInArrow(lambda t: answer_blocks(t, n), ROWS)
    told = stage(told, "substring-answers")
    dealt = docs.withColumn("to", F.coalesce(grams.part_column("doc_id", n), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))).repartition(n, "to")
    asked = dealt.where(F.col("doc_id").isNotNull()).groupBy("to")
    windows = asked.cogroup(told.repartition(n, "to").groupBy("to")).applyInArrow(lambda d, t: boundary_windows(d, t, n, window, gram), ROWS)
    more = stage(windows.repartition(n, "to").groupBy("to").applyInArrow(lambda t: answer_windows(t, n), ROWS), "substring-windows")
    return dealt.groupBy("to").cogroup(told.unionByName(more).repartition(n, "to").groupBy("to")).applyInArrow(lambda d, t: parse(d, t, window, gram), OUT)
