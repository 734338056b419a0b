"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct shingles of ``SHINGLE`` words. Two documents link when their
sets' Jaccard similarity reaches ``PERCENT`` / 100; integers decide. Documents with equal sets are
one class, worked on once.

1. Shingles are counted over all documents, spread by their hash. Every document learns how many of
   its shingles stand nowhere else, and the frequency of the others. A shingle that is frequent
   within one map batch isn't sent for counting; it counts as most frequent everywhere.
2. A set is ordered rarest first (ties by hash). Two linked sets share a shingle within their first
   ``n - ceil(0.85 n) + 1``, so only these prefixes are joined; a document whose prefix holds only
   shingles of its own is out at once.
3. First each prefix shingle's documents are compared with one of them, the one with the most in
   reserve; verified links give components. Then all pairs that share a prefix shingle and are not
   yet in one component are compared, but for those of the first round. A large group of near copies
   thus costs about one comparison a member, and still no link between different texts is lost.
4. Before a pair is compared it has to pass the length filter, the positional filter (what follows
   the shared shingle must suffice) and the suffix filter (the sets' counts over 32 hash ranges
   bound their distance from below). Pairs are deduplicated and verified once, on the whole sets.
5. A shingle that more than ``SPLIT`` prefixes hold is split: its documents, sorted by the size of
   their sets, are cut into blocks, and only pairs of blocks whose sizes allow a link, and that are not
   of one component, are compared, each pair of blocks on its own.

Defined results: a null or empty text has no shingles and its own component; a text with fewer
words than a shingle is one shingle; texts are of any length; equal rows link; a row without doc_id
gets a null component; rows that share a doc_id are one document: each has the size of its own set,
and what links to one of them is linked with all; for ``keep_one`` they are documents of their own; an empty
table gives no rows; further columns are ignored. Shingles are told apart by 64-bit hashes, whole sets by their size and 128
bits; results are exact but for collisions of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.staging import parts_for, stage, unstage
from . import grams
from .columns import private

SHINGLE, PERCENT = 4, 85
#: Shingles gathered before they are dealt out, and the documents of such a batch beyond which one is frequent.
FLUSH, FREQUENT = 400_000, 32
MOST = 2**31 - 1
RANGES = 32
#: Bytes of text whose shingles are counted in one task.
PART_BYTES = 10_000_000
#: Documents of one prefix shingle that are compared in one go.
SPLIT = 4096
ROWS = "to int, kind int, blob binary"
SET = ("set_id", "set_id_2")
SETS = {"doc": "i8", "count": "i4"}
TOKENS, MARKS = {"token": "u8"}, {"token": "u8"}
LEARNT = {"doc": "i8", "token": "u8", "df": "i4"}
POSTING = {"token": "u8", "doc": "i8", "n": "i4", "at": "i4", "component": "i8"}


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingle hashes, sorted within each text, and where each text's begin."""
    words = grams.split_words(texts, lower=True)
    n, docs = len(words.hashes), len(words.doc_at) - 1
    hashes = grams.RangeHash(words.hashes, 0)
    sizes = np.diff(words.doc_at)
    full = sizes >= shingle
    per = np.where(full, sizes - shingle + 1, (sizes > 0).astype(np.int64))
    at = np.cumsum(per) - per
    start = np.repeat(words.doc_at[:-1] - at, per) + np.arange(per.sum())
    doc = np.repeat(np.arange(docs), per)
    got = hashes(start, np.minimum(start + shingle, words.doc_at[doc + 1])) if n else np.empty(0, np.uint64)
    order = np.lexsort((got, doc))
    got, doc = got[order], doc[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])
    got, doc = got[new], doc[new]
    return got, np.searchsorted(doc, np.arange(docs + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set that it links to."""
    return -(-n * percent // 100)


def overlap_needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least o with 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def rows(triples: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*triples, strict=True) if triples else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["to", "kind", "blob"])


def sizes(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, set_id_2) of every row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in grams.blocks(batch):
                got, at = shingle_sets(batch.column(1).slice(a, b - a), shingle)
                set_ids = []
                for base in grams.BASES[1:]:  # sums of two independent hashes of each shingle
                    sums = np.zeros(len(got) + 1, np.uint64)
                    np.cumsum(grams.mix(got ^ base), out=sums[1:])
                    set_ids.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *set_ids], ["doc_id", "n_shingles", *SET])

    return documents.mapInArrow(measured, "doc_id long, n_shingles long, set_id long, set_id_2 long")


def settle(ids: np.ndarray, sets: list[np.ndarray], buckets: int) -> list[tuple[int, int, bytes]]:
    """What a batch sends: its sets by bucket (0), marks of frequent shingles (1), and these as learnt (2)."""
    seen: dict[int, int] = {}
    keep = []
    for k in np.argsort(ids, kind="stable").tolist():  # equal sets once, for the smallest document
        s = sets[k]
        key = hash(s.tobytes())
        if len(s) and not (key in seen and np.array_equal(sets[seen[key]], s)):
            seen[key] = k
            keep.append(k)
    if not keep:
        return []
    token = np.concatenate([sets[k] for k in keep])
    doc = np.repeat(ids[keep], [len(sets[k]) for k in keep])
    values, back, counts = np.unique(token, return_inverse=True, return_counts=True)
    often = counts > FREQUENT
    hot = often[back]
    out = []
    marks = values[often]
    if len(marks):
        out += [(b, 1, blob) for b, blob in grams.dealt({"token": marks}, bucket_of(marks, buckets))]
        out += [(p, 2, blob) for p, blob in grams.dealt({"doc": doc[hot], "token": token[hot], "df": np.full(hot.sum(), MOST, "i4")}, grams.part_of(doc[hot], buckets))]
    token, doc = token[~hot], doc[~hot]
    to = bucket_of(token, buckets)
    order = np.argsort(to, kind="stable")
    token, doc, to = token[order], doc[order], to[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        first = np.flatnonzero(np.diff(doc[a:b], prepend=doc[a] - 1))
        table = {"doc": doc[a:b][first], "count": np.diff(np.append(first, b - a)).astype("i4")}
        out.append((int(to[a]), 0, grams.to_blob(table) + grams.to_blob({"token": token[a:b]})))
    return out


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def emit_sets(documents: DataFrame, n: int, shingle: int) -> DataFrame:
    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in grams.blocks(batch):
                got, at = shingle_sets(batch.column(1).slice(a, b - a), shingle)
                ids.append(all_ids[a:b])
                sets += np.split(got, at[1:-1])
                held += len(got)
                if held >= FLUSH:
                    yield rows(settle(np.concatenate(ids), sets, n))
                    ids, sets, held = [], [], 0
        if ids:
            yield rows(settle(np.concatenate(ids), sets, n))

    return documents.mapInArrow(emitted, ROWS)


def count_bucket(table: pa.Table, n: int) -> pa.Table:
    """Document frequencies of a bucket's shingles, told to the documents that have them; those of one document are left out."""
    out, tables, tokens, marks = [], [], [], []
    for to, kind, blob in zip(*(table[c].to_pylist() for c in ("to", "kind", "blob")), strict=True):
        if kind == 2:
            out.append((to, 2, blob))
        elif kind == 1:
            marks.append(blob)
        else:
            size = int(np.frombuffer(blob, np.int64, 1)[0]) * 12 + 8
            tables.append(blob[:size])
            tokens.append(blob[size:])
    s, token = grams.from_blobs(tables, SETS), grams.from_blobs(tokens, TOKENS)["token"]
    doc = np.repeat(s["doc"], s["count"])
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    first = np.flatnonzero(np.diff(token, prepend=token[:1] + np.uint64(1))) if len(token) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(token)))
    df = np.repeat(count, count)
    df[np.isin(token, grams.from_blobs(marks, MARKS)["token"])] = MOST
    kept = df > 1
    told = {"doc": doc[kept], "token": token[kept], "df": df[kept].astype("i4")}
    out += [(p, 2, blob) for p, blob in grams.dealt(told, grams.part_of(told["doc"], n))]
    return pa.Table.from_batches([rows(out)])


def order_sets(classes: pa.Table, told: pa.Table, percent: int) -> pa.Table:
    """The ordered sets of a partition's class representatives that may link to others.

    unique is how many shingles come before the ones listed, in no other document.
    """
    x = grams.from_blobs(told["blob"].to_pylist(), LEARNT)
    chosen = np.isin(x["doc"], classes["doc_id"].to_numpy())
    order = np.lexsort((x["token"][chosen], x["df"][chosen], x["doc"][chosen]))
    doc, token = x["doc"][chosen][order], x["token"][chosen][order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])  # a repeated row tells its shingles twice
    doc, token = doc[new], token[new]
    ids, first, count = np.unique(doc, return_index=True, return_counts=True)
    size = dict(zip(classes["doc_id"].to_pylist(), classes["n_shingles"].to_pylist(), strict=True))
    n = np.array([size[d] for d in ids.tolist()], np.int64)
    unique = n - count
    may = unique < n - needed(n, percent) + 1
    sets = [token[a : a + c].tobytes() for a, c in zip(first[may].tolist(), count[may].tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(ids[may], pa.int64()), pa.array(n[may], pa.int64()), pa.array(unique[may], pa.int64()), pa.array(sets, pa.binary())], ["doc", "n", "unique", "tokens"])


def emit_prefixes(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Postings of prefix shingles, by bucket; sets has component, null for documents alone so far."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, size, unique, blob, component in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                token = np.frombuffer(blob, "u8")
                prefix = token[: size - int(needed(np.int64(size), percent)) + 1 - unique]
                spread = np.bincount((token >> np.uint64(59)).astype(np.int64), minlength=RANGES).astype("i4")
                k = len(prefix)
                parts.append({"token": prefix, "doc": np.full(k, doc), "n": np.full(k, size, "i4"), "at": (unique + np.arange(k)).astype("i4"), "component": np.full(k, doc if component is None else component), "spread": np.broadcast_to(spread, (k, RANGES)), "unique": np.full(k, unique, "i4")})
            if parts:
                x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
                yield rows([(b, 0, blob) for b, blob in grams.dealt(x, bucket_of(x["token"], n))])

    return sets.select("doc", "n", "unique", "tokens", "component").mapInArrow(emitted, ROWS)


def read_postings(blobs: list[bytes], ordered: bool = True) -> dict[str, np.ndarray]:
    """Postings of many blobs: by shingle, the ones with the most in reserve first, or as they come."""
    parts = []
    for blob in blobs:
        size, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        x = {}
        for name, kind, width in (*((k, t, 1) for k, t in POSTING.items()), ("spread", "i4", RANGES), ("unique", "i4", 1)):
            got = np.frombuffer(blob, kind, size * width, at)
            x[name] = got.reshape(size, width) if width > 1 else got
            at += got.nbytes
        parts.append(x)
    x = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    if not ordered:
        return x
    order = np.lexsort((x["doc"], x["at"], x["token"]))
    return {c: v[order] for c, v in x.items()}


def passes(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of postings of one shingle pass the length, positional and suffix filters."""
    n, m = x["n"][a].astype(np.int64), x["n"][b].astype(np.int64)
    need = overlap_needed(n, m, percent)
    ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - x["at"][a], m - x["at"][b]) >= need)
    where = np.flatnonzero(ok)
    # shingles of one document alone are in no other set; the rest differ at least by their counts in each range
    apart = np.abs(x["spread"][a[where]] - x["spread"][b[where]]).sum(1) + x["unique"][a[where]] + x["unique"][b[where]]
    ok[where] = apart <= (n + m - 2 * need)[where]
    return ok


def compared(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Those pairs of documents, as rows of two, of postings of one shingle that lie across components and pass the filters."""
    differ = (x["doc"][a] != x["doc"][b]) & (x["component"][a] != x["component"][b])
    a, b = a[differ], b[differ]
    ok = passes(x, a, b, percent)
    a, b = x["doc"][a[ok]], x["doc"][b[ok]]
    return np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def pair_rows(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["x", "y"])


def posting_lists(table: pa.Table) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """The postings of a bucket and, of each shingle with two or more, where they begin and how many they are."""
    x = read_postings(table["blob"].to_pylist())
    first = np.flatnonzero(np.diff(x["token"], prepend=x["token"][:1] + np.uint64(1)))
    count = np.diff(np.append(first, len(x["token"])))
    return x, [(f, c) for f, c in zip(first.tolist(), count.tolist(), strict=True) if c > 1]


def heads_bucket(table: pa.Table, percent: int) -> pa.Table:
    """Candidate pairs of a bucket: each posting list's documents with its first one."""
    x, lists = posting_lists(table)
    if not lists:
        return pa.Table.from_batches([pair_rows([])])
    heads = np.repeat([f for f, _ in lists], [c - 1 for _, c in lists])
    others = np.concatenate([np.arange(f + 1, f + c) for f, c in lists])
    return pa.Table.from_batches([pair_rows([compared(x, heads, others, percent)])])


BLOCK = "token long, block int, least long, most long, component long, blob binary"


def blocks_bucket(table: pa.Table) -> pa.Table:
    """The posting lists of a bucket that lie across components, sorted by size of set and cut into blocks.

    A block of one component has its number.
    """
    x, lists = posting_lists(table)
    out = []
    for f, c in lists:
        if (x["component"][f : f + c] == x["component"][f]).all():
            continue
        order = f + np.lexsort((x["doc"][f : f + c], x["n"][f : f + c]))
        for k in range(-(-c // SPLIT)):
            at = order[k * SPLIT : (k + 1) * SPLIT]
            part = {name: v[at] for name, v in x.items()}
            one = int(part["component"][0]) if (part["component"] == part["component"][0]).all() else None
            out.append((int(part["token"][:1].view(np.int64)[0]), k, int(part["n"][0]), int(part["n"][-1]), one, grams.to_blob(part)))
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["token", "block", "least", "most", "component", "blob"])


def compare_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs within a block (the second one null) or between two."""
    for batch in batches:
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = read_postings([one] if two is None else [one, two], ordered=False)
            size = int(np.frombuffer(one, np.int64, 1)[0])
            found = []
            for k in range(size):
                others = np.arange(k + 1, size) if two is None else np.arange(size, len(x["doc"]))
                found.append(compared(x, np.full(len(others), k), others, percent))
            yield pair_rows(found)


def pairs_across(postings: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidate pairs (x, y), repeated, of documents in different components that share a prefix shingle."""
    blocks = stage(postings.repartition(n, "to").groupBy("to").applyInArrow(blocks_bucket, BLOCK), "jaccard-blocks")
    within = blocks.where("component is null").select("blob", F.lit(None).cast("binary").alias("other"))
    one, two = (blocks.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "least", "most", "component")]) for k in (1, 2))
    may = (F.col("block_1") < F.col("block_2")) & (F.col("most_1") * 100 >= F.col("least_2") * percent) & ~F.coalesce(F.col("component_1") == F.col("component_2"), F.lit(False))
    met = one.join(two, "token").where(may).select("token", "block_1", "block_2")
    left = blocks.select("token", F.col("block").alias("block_1"), "blob")
    right = blocks.select("token", F.col("block").alias("block_2"), F.col("blob").alias("other"))
    between = met.join(left, ["token", "block_1"]).join(right, ["token", "block_2"]).select("blob", "other")
    return within.unionByName(between).mapInArrow(lambda batches: compare_blocks(batches, percent), "x long, y long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) with linked: whether their whole sets link."""
    one = sets.select(F.col("doc").alias("x"), F.col("n").alias("n_x"), F.col("tokens").alias("t_x"))
    two = sets.select(F.col("doc").alias("y"), F.col("n").alias("n_y"), F.col("tokens").alias("t_y"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for n, a, m, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                both = len(np.intersect1d(np.frombuffer(a, "u8"), np.frombuffer(b, "u8"), assume_unique=True))
                linked.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    return pairs.join(two, "y").join(one, "x").select("x", "y", "n_x", "t_x", "n_y", "t_y").mapInArrow(verified, "x long, y long, linked boolean")


def told_apart(documents: DataFrame, known: DataFrame) -> DataFrame | None:
    """Where rows of one doc_id hold different sets: (doc_id, text, own), own a number of each text of such an id, else the doc_id."""
    sets = F.struct(*SET, "n_shingles")
    mixed = stage(known.where("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("mixed")), "jaccard-mixed")
    if mixed.isEmpty():
        return None
    return documents.join(mixed, "doc_id", "left").select("doc_id", "text", F.when(F.col("mixed"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("own"))


def as_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def join(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = as_documents(documents)
    known = stage(sizes(docs, shingle), "jaccard-sizes")
    apart = told_apart(docs, known)
    if apart is None:
        return _join(docs, known, shingle, percent)
    apart = stage(apart, "jaccard-apart")
    own = apart.select(F.col("own").alias("doc_id"), "text")
    found = stage(_join(own, stage(sizes(own, shingle), "jaccard-sizes"), shingle, percent), "jaccard-own")
    names = apart.select("doc_id", "own").where("own <> doc_id").distinct()
    rows = found.withColumnRenamed("doc_id", "own").join(names, "own", "left").withColumn("doc_id", F.coalesce("doc_id", "own"))
    # components by their smallest doc_id; those that rows of one doc_id lie in are one
    least = rows.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    rows = stage(rows.join(least, "component_id", "left"), "jaccard-rows")
    shared = rows.join(names.select("own"), "own", "left_semi").select(F.col("doc_id").alias("x"), F.col("least").alias("y")).distinct()
    merged = connected_components(shared, "x", "y", one_task=0).select(F.col("id").alias("least"), "component")
    return rows.join(merged, "least", "left").select("doc_id", "n_shingles", F.coalesce("component", "least").alias("component_id"))


def _join(docs: DataFrame, known: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The join of documents whose rows of one doc_id hold one set; known has their sizes."""
    n = parts_for(docs, "text", PART_BYTES)
    copies = known.where("n_shingles > 0").groupBy(*SET, "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    classes = copies.where("class_id is not null").select(F.col("class_id").alias("doc_id"), "n_shingles").withColumn("to", grams.part_column("doc_id", n))

    told = emit_sets(docs.where("doc_id is not null"), n, shingle).repartition(n, "to").groupBy("to").applyInArrow(lambda t: count_bucket(t, n), ROWS)
    sets = classes.repartition(n, "to").groupBy("to").cogroup(told.repartition(n, "to").groupBy("to")).applyInArrow(lambda c, t: order_sets(c, t, percent), "doc long, n long, unique long, tokens binary")
    sets = stage(sets, "jaccard-sets")

    alone = emit_prefixes(sets.withColumn("component", F.lit(None).cast("long")), n, percent)
    first = alone.repartition(n, "to").groupBy("to").applyInArrow(lambda t: heads_bucket(t, percent), "x long, y long").distinct()
    tried = stage(verify(first, sets, percent), "jaccard-tried")
    found = stage(connected_components(tried.where("linked"), "x", "y", one_task=0), "jaccard-found")
    grouped = sets.join(found.select(F.col("id").alias("doc"), "component"), "doc", "left")
    rest = pairs_across(emit_prefixes(grouped, n, percent), n, percent).distinct().join(tried, ["x", "y"], "left_anti")
    more = stage(verify(rest, sets, percent), "jaccard-more")
    every = found.select(F.col("id").alias("x"), F.col("component").alias("y")).unionByName(more.where("linked").select("x", "y"))
    final = stage(connected_components(every, "x", "y", one_task=0), "jaccard-components")
    unstage(sets, tried, found, more)
    # only of documents that aren't alone; written, so that its size is known, by which Spark chooses the join
    named = copies.join(final.select(F.col("id").alias("class_id"), "component"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    named = stage(named.where("members > 1 or component_id <> class_id").select(*SET, "n_shingles", "component_id"), "jaccard-named")
    unstage(final)
    with_sets = known.join(named, [*SET, "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return with_sets.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows of one doc_id whose sets differ are documents of their own.

    Of rows that share doc_id and set, one stays. Rows without doc_id stay.
    """
    name = private(documents.columns)
    gone_id, again, own = (f"{name}{c}" for c in ("gone", "again", "own"))
    docs = as_documents(documents)
    known = stage(sizes(docs, shingle), "jaccard-sizes")
    apart = told_apart(docs, known)
    if apart is None:
        found, here = stage(_join(docs, known, shingle, percent), "jaccard-join"), documents.withColumn(own, F.col("doc_id").cast("long"))
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    else:
        apart = stage(apart, "jaccard-apart")
        numbered = apart.select(F.col("own").alias("doc_id"), "text")
        found = stage(_join(numbered, stage(sizes(numbered, shingle), "jaccard-sizes"), shingle, percent), "jaccard-join")
        names = apart.select("doc_id", "own").where("own <> doc_id").distinct()
        named = found.select(F.col("doc_id").alias("own"), "component_id").join(names, "own", "left").select("own", "component_id", F.coalesce("doc_id", "own").alias("doc_id"))
        first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "own")).alias("first"))
        gone = named.join(first, "component_id").where("own <> first.own").select(F.col("own").alias(gone_id)).distinct()
        number = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
        mixed = names.select(F.col("doc_id").alias(again)).distinct()
        here = documents.join(mixed, F.col("doc_id") == F.col(again), "left").withColumn(own, F.when(F.col(again).isNotNull(), number).otherwise(F.col("doc_id").cast("long"))).drop(again)
    gone = stage(gone, "jaccard-gone")  # written, so that its size is known, by which Spark chooses the join
    kept = here.join(gone, F.col(own) == F.col(gone_id), "left_anti")
    repeated = stage(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(again)), "jaccard-repeated")
    unstage(found)
    if not repeated.isEmpty():
        once = kept.join(repeated, F.col(own) == F.col(again), "left_semi").dropDuplicates([own])
        kept = kept.join(repeated, F.col(own) == F.col(again), "left_anti").unionByName(once)
    return kept.drop(own)
