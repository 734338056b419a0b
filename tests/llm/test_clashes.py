"""Rows that share a doc_id, and columns whose names operators use themselves."""

import pytest

from vectorloom.llm import decontaminate, ngram_join, secret_scan, substring_dedup, toxicity
from vectorloom.llm.columns import private


def numbered(word, n):
    return " ".join(f"{word}{k}" for k in range(n))


def test_private_names():
    assert private(["doc_id", "_x"]) == "__"
    assert private(["__Text", "____a", "b"]) == "_____"


def test_substring_dedup_of_two_texts_under_one_id(spark):
    a, b = numbered("a", 60), numbered("b", 60)
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (None, a)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect())
    assert found == [(0, 60, 0), (0, 60, 0), (1, 60, 0), (5, 60, 0), (5, 60, 0), (5, 60, 60)]


def test_substring_dedup_keeps_windows_of_another_row_of_one_id(spark):
    """Repeated windows at boundaries of blocks, in one row of two that share an id."""
    shared = numbered("s", 23)
    docs = spark.createDataFrame([(1, f"{numbered('p', 7)} {shared} {numbered('q', 9)}"), (4, f"{numbered('r', 5)} {shared} {numbered('t', 8)}"), (4, numbered("u", 36))], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup(docs).collect())
    assert found == [(1, 0), (4, 0), (4, 23)]


def test_jaccard_of_two_texts_under_one_id(spark):
    a, b, c = numbered("a", 60), numbered("b", 60), numbered("c", 60)
    rows = [(1, a), (2, b), (2, a), (3, b), (4, c), (4, c), (6, c + " end"), (7, numbered("d", 9)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect())
    assert found == [(0, 57, None), (1, 57, 1), (2, 57, 1), (2, 57, 1), (3, 57, 1), (4, 57, 4), (4, 57, 4), (6, 58, 4), (7, 6, 7)]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in ngram_join.keep_one(docs).collect()))
    assert kept == [(0, a), (1, a), (2, b), (4, c), (7, numbered("d", 9))]


def test_columns_that_operators_use_themselves(spark):
    key = "token = abcdef123456"
    docs = spark.createDataFrame([(1, f"x {key}", "t1", "b1", 0.25, 9, 8, "g", "o"), (2, "you idiot scum moron", "t2", "b2", 0.5, 7, 6, "g", "o")], "doc_id long, text string, __text string, __base string, __score double, __id int, __key int, __gone string, __own string")
    rest = lambda df: sorted(tuple(r)[2:] for r in df.collect())
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and rest(masked) == rest(docs)
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == ["x [SECRET]", "you idiot scum moron"]
    kept = toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and rest(kept) == rest(docs.where("doc_id = 1"))
    leaks = spark.createDataFrame([("i", f"x {key}")], "item_id string, text string")
    for mode in ("documents", "spans"):
        clean = decontaminate.decontaminate(docs, leaks, mode=mode)
        assert clean.columns == docs.columns and rest(clean) == rest(docs.where("doc_id = 2") if mode == "documents" else docs)
    once = ngram_join.keep_one(docs)
    assert once.columns == docs.columns and rest(once) == rest(docs)
