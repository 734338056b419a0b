"""Benchmark decontamination: token windows of documents against a hash set of test n-grams.

A word is a maximal run of characters that are neither ASCII separators nor ASCII punctuation,
after lower-casing A-Z only. A window is ``n`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. The distinct windows are hashed once and sent to every
executor, with a bitmap of the hashes that lets few other windows through; each document's words
are hashed once, its windows from their words' hashes, and every window that is found is verified on
the words themselves. Only hits are shuffled. Everything is a DataFrame expression.

The hash set is broadcast only while the benchmark is at most ``BROADCAST_WORDS`` words (about
100 bytes for each window); beyond it the lookup is a shuffled join on the window hash, before which
the bitmap still lets few windows through up to ``BITMAP_WORDS``. A window that very many documents
share is one row of the lookup, so the join can be split at it.

Defined results: a null or empty text has no words and no hits; items whose id or text is null are
left out; texts of any length are scanned whole; repeated document rows get a result row each; an
empty benchmark hits nothing; columns of the inputs other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .columns import private

N = 10
BROADCAST_WORDS, BITMAP_WORDS = 500_000, 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same classes for a text in which A-Z have not been lower-cased.
CASED_SEPARATORS, CASED_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def window_hash(hashes: Column, at: Column, n: int) -> Column:
    """The hash of n words from one place on, by their hashes."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])


def window_hashes(hashes: Column, n: int) -> Column:
    """The hash of each window of n words, by its start."""
    last = F.size(hashes) - n
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: window_hash(hashes, i, n)))


def bitmap(hashes: np.ndarray) -> Callable[[Column], Column]:
    """A test that holds for each of these hashes and for few others: one bit each of a constant."""
    size = 1 << max(4, (16 * len(hashes)).bit_length() - 6)
    cells = np.zeros(size, np.int64)
    np.bitwise_or.at(cells, (hashes >> 6) & (size - 1), np.int64(1) << (hashes & 63))
    signed = ",".join(map(str, cells.tolist()))
    bits = F.split(F.lit(signed), ",").cast("array<bigint>")  # folded to a literal
    cell = lambda h: F.get(bits, F.shiftright(h, 6).bitwiseAND(size - 1).cast("int"))
    return lambda h: F.call_function("shiftrightunsigned", cell(h), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def benchmark_windows(benchmark: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (hash, length, words, items) of a benchmark."""
    items = (
        benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
        .where(F.col("item").isNotNull() & (F.size("w") > 0))
        .withColumn("m", F.least(F.size("w"), F.lit(n)))
    )
    starts = items.select("item", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    grams = starts.select("item", F.col("m").alias("len"), F.slice("w", F.col("at"), F.col("m")).alias("gram"))
    hashed = F.lit(None).cast("bigint")
    for m in range(1, n + 1):
        hashed = F.when(F.col("len") == m, window_hash(word_hashes(F.col("gram")), F.lit(0), m)).otherwise(hashed)
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).select(hashed.alias("hash"), "len", "gram", "items")


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row: doc_id, n_words, hits (arrays of start and length), items (sorted)."""
    lookup = benchmark_windows(benchmark, n)
    size = lookup.agg(F.sum("len").alias("words"), F.collect_set("len").alias("lengths")).first()
    lengths, words_there = sorted(size["lengths"] or [], reverse=True), size["words"] or 0
    maybe = None
    if words_there <= BITMAP_WORDS:
        maybe = bitmap(lookup.select("hash").distinct().toArrow()["hash"].to_numpy())
    if words_there <= BROADCAST_WORDS:
        lookup = F.broadcast(lookup)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), words(F.col(text)).alias("w"))
    docs = docs.select("doc_id", "key", "w", word_hashes(F.col("w")).alias("h"))
    docs = docs.select("doc_id", "key", "w", *[window_hashes(F.col("h"), m).alias(f"h{m}") for m in lengths])
    window = lambda h, m, at, gram: F.struct(h.alias("hash"), F.lit(m).alias("len"), at.alias("start"), gram.alias("gram"))

    def candidates(m: int) -> Column:
        h = F.col(f"h{m}")
        starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        if maybe is not None:
            starts = F.filter(starts, lambda i: maybe(F.get(h, i)))
        return F.transform(starts, lambda i: window(F.get(h, i), m, i, F.slice("w", i + 1, m)))

    # a row of length 0 keeps each document; it finds nothing and is dealt by the document, not to one place
    kept = [F.array(window(F.xxhash64("doc_id", "key"), 0, F.lit(0), F.array().cast("array<string>")))]
    for m in lengths:
        kept.append(candidates(m))
    docs = docs.select("doc_id", "key", F.size("w").alias("n"), F.concat(*kept).alias("kept"))
    # outer, as Spark would else push a filter on the size of the array, and all that makes it, below the projections
    spread = docs.select("doc_id", "key", "n", F.explode_outer("kept").alias("x")).select("doc_id", "key", "n", "x.*")
    met = spread.join(lookup, ["hash", "len", "gram"], "left").where((F.col("len") == 0) | F.col("items").isNotNull())
    met = met.select("doc_id", "key", F.when(F.col("len") == 0, F.col("n")).alias("words"), F.when(F.col("len") > 0, F.struct("start", "len")).alias("hit"), "items")
    found = met.groupBy("doc_id", "key").agg(
        F.max("words").cast("bigint").alias("n_words"), F.count("words").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return found.select("doc_id", "key", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def covered(hits: Column) -> Column:
    """The sorted distinct word positions inside hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))


def report(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size(covered(F.col("hits"))).cast("bigint")
    return find_hits(documents, benchmark, n).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "documents") -> DataFrame:
    """Documents without benchmark passages, with the columns that came in.

    mode "documents" drops each document with a hit; "spans" keeps it and cuts the words inside
    hits, each with the separators before it. Documents without hits are returned unchanged.
    """
    own = private(documents.columns)
    id_, key, hit = (f"{own}{c}" for c in ("id", "key", "hit"))
    hits = find_hits(documents, benchmark, n).where(F.size("hits") > 0).select(F.col("doc_id").alias(id_), F.col("key").alias(key), covered(F.col("hits")).alias(hit)).dropDuplicates([id_, key])
    hits = stage(hits if mode == "spans" else hits.drop(hit), "decontaminate-hits")  # its size is known then, by which Spark chooses the join
    same = documents["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(documents["text"]) == F.col(key))
    if mode == "documents":
        return documents.join(hits, same, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    lead = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({lead})({CASED_WORDS})"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(F.col(hit), i))
    tail = F.regexp_extract(F.col("text"), f"({lead})$", 1)
    cut = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return documents.join(hits, same, "left").select(*[cut.alias("text") if c == "text" else documents[c] for c in documents.columns])
