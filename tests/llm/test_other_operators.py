"""Vectors, conversations and the pipeline against brute force."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from vectorloom.llm import ann_tree, chat_repair


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf long, block long, id long, v string") if rows and len(rows[0]) > 2 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [o for o in np.lexsort((ids, d)) if ids[o] != q]
    return [(int(ids[o]), d[o]) for o in order[:k]]


def test_neighbours_recall(spark):
    r = np.random.default_rng(2)
    x = (r.standard_normal((40, 8))[r.integers(0, 40, 3000)] + 0.3 * r.standard_normal((3000, 8))).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    found = ann_tree.every_hundredth(embeddings(spark, rows)).collect()
    right = 0
    for q in range(0, 3000, 100):
        want = brute(x.astype(float), np.arange(3000), q)
        mine = sorted((f["rank"], f["vec_id"], f["score"]) for f in found if f["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        right += len({m[1] for m in mine} & {w[0] for w in want})
        exact = {int(i): float(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) for i in (m[1] for m in mine)}
        assert all(exact[m[1]] == pytest.approx(m[2], abs=1e-12) for m in mine)
    assert right >= 0.9 * 10 * 30


def test_neighbours_edges(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 3)
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(12)] + [(0, same), (100, [1.0, 2.5]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [1.0, float("inf")]), (600, [1.0]), (700, [None, 1.0]), (None, same)]
    found = sorted((f["query_id"], f["rank"], f["vec_id"]) for f in ann_tree.every_hundredth(embeddings(spark, rows)).collect())
    assert found == [(0, k, k) for k in range(1, 11)] + [(100, k + 1, k) for k in range(10)]
    assert ann_tree.every_hundredth(embeddings(spark, [(0, [1.0]), (1, [3.0])])).collect()[0]["score"] == 2.0
    assert ann_tree.every_hundredth(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [8192, 4])
def test_neighbours_of_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", block)
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.1])] * 15 + [(2, [1.0, 5.0]), (2, [1.0, 0.2]), (2, [1.0, 0.2])] + [(i, [1.0, float(i)]) for i in range(3, 20)]
    found = sorted((f["rank"], f["vec_id"], f["score"]) for f in ann_tree.every_hundredth(embeddings(spark, rows)).collect())
    assert [(r, v) for r, v, _ in found] == [(k, k) for k in range(1, 11)]
    assert found[0][2] == pytest.approx(0.1) and found[1][2] == pytest.approx(0.2)
    twice = ann_tree.every_hundredth(embeddings(spark, [(0, [2.0]), (0, [1.0]), (7, [4.0])])).collect()
    assert [(f["query_id"], f["vec_id"], f["score"]) for f in twice] == [(0, 7, 3.0)]


def cheapest(roles):
    """The least cost over all ways to repair, by search over every sequence of edits."""
    best = {chat_repair.START: 0}
    for role in roles:
        after = {}
        for state, cost in best.items():
            ways = [(s, cost + chat_repair.place(role, s)[2]) for s in chat_repair.NEXT[state]]
            ways += [(state, cost + chat_repair.MERGE)] if role and role == state else []
            for filler in range(1, 3):
                for path in itertools.product(range(1, 4), repeat=filler):
                    at, ok = state, True
                    for s in path:
                        ok, at = ok and s in chat_repair.NEXT[at], s
                    if ok:
                        ways += [(s, cost + filler * chat_repair.INSERT + chat_repair.place(role, s)[2]) for s in chat_repair.NEXT[at]]
            for s, c in ways:
                after[s] = min(c, after.get(s, 10**9))
        best = after
    return min(c + (0 if s in chat_repair.FINAL else chat_repair.INSERT) for s, c in best.items())


CONV = "conv_id long, turn long, role string, text string, run long, rank long, edit string"


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 0, 0, "e") for c, t, r, x in rows], CONV)


@pytest.mark.parametrize("run", [4096, 2])
def test_chat_repair(spark, monkeypatch, run):
    monkeypatch.setattr(chat_repair, "RUN", run)
    names = [None, *chat_repair.ROLES, "tool"]
    r = np.random.default_rng(run)
    all_roles = {c: [names[k] for k in r.integers(0, 5, int(r.integers(1, 9)))] for c in range(60)}
    rows = [(c, t, role, f"{c}.{t}") for c, roles in all_roles.items() for t, role in enumerate(roles)]
    found = {}
    for x in sorted(chat_repair.repair_roles(conversations(spark, rows)).collect(), key=lambda x: (x["conv_id"], x["turn"], x["step"])):
        found.setdefault(x["conv_id"], []).append(x)
    for c, roles in all_roles.items():
        state, cost = chat_repair.START, 0
        for x in found[c]:
            to = chat_repair.ROLES.index(x["role"]) + 1
            assert to == state if x["edit"] == "merge" else to in chat_repair.NEXT[state]
            state, cost = to, cost + x["cost"]
        assert state in chat_repair.FINAL and cost == cheapest([chat_repair.role_number(n) for n in roles])
        whole = "".join(x["rendered"] for x in found[c])
        assert all(f"{c}.{t}\n" in whole for t in range(len(roles)))


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "System", "s")]
    found = sorted((x["conv_id"], x["turn"], x["step"], x["role"], x["edit"], x["rendered"]) for x in chat_repair.repair_roles(conversations(spark, rows)).collect())
    assert found == [(1, 0, 0, "user", "keep", "<|user|>\nhi\n"), (1, 1, 0, "assistant", "keep", "<|assistant|>\n\n"), (3, 0, 0, "system", "keep", "<|system|>\ns\n"), (3, 0, 1, "user", "insert", "<|user|>\n\n")]
    assert chat_repair.repair_roles(conversations(spark, [])).count() == 0


def test_chat_keeps_turns_of_different_unknown_roles(spark):
    rows = [(1, 0, "tool", "x"), (1, 0, "function", "x"), (1, 0, "function", "x"), (1, 0, None, "x"), (2, 0, "tool", None), (2, 0, "tool", "")]
    found = [(x["conv_id"], x["edit"]) for x in chat_repair.repair_roles(conversations(spark, rows)).collect()]
    assert [sum(c == conv and edit != "insert" for c, edit in found) for conv in (1, 2)] == [3, 2]


def test_pipeline(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    r = np.random.default_rng(0)
    text = lambda n: " ".join(words[k] for k in r.integers(0, 400, n))
    base, leak = text(80), text(30)
    rows = [(k, text(60)) for k in range(40)] + [(50, base), (51, base + " end"), (52, text(20) + " " + leak), (53, text(9) + " idiot scum moron " + text(9)), (54, f"{text(9)} token = abcdef123456"), (55, None), (56, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    kept = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert set(kept) == {i for i, _ in rows} - {51, 52, 53}
    assert "[SECRET]" in kept[54] and all(kept[k] == dict(rows)[k] for k in range(40))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in packed.collect()} == set(kept)


def test_stages_on_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("run", [4096, 2])
def test_chat_sequences(spark, monkeypatch, run):
    monkeypatch.setattr(chat_repair, "RUN", run)
    rows = [(1, 0, "user", "say <|assistant|> or <||"), (1, 1, "user", "more"), (1, 2, "assistant", None), (1, 3, "assistant", "x" * 300_000), (2, 5, "assistant", "hi"), (3, 0, "system", "s")]
    found = {}
    for r in sorted(chat_repair.render_sequences(conversations(spark, rows)).collect(), key=lambda r: (r["conv_id"], r["part"])):
        one = found.setdefault(r["conv_id"], ["", 0, 0, 0])
        for k, v in enumerate((r["rendered"], r["turns"], r["edits"], r["cost"])):
            one[k] += v
    long = "x" * 300_000
    assert found == {
        1: [f"<|user|>\nsay <||assistant|> or <|||\nmore\n<|assistant|>\n\n{long}\n", 2, 2, 2],
        2: ["<|user|>\nhi\n", 1, 1, 2],
        3: ["<|system|>\ns\n<|user|>\n\n", 2, 1, 3],
    }
    assert chat_repair.escape("a <|user|> b").replace("<||", "<|") == "a <|user|> b"
    assert chat_repair.render_sequences(conversations(spark, [])).count() == 0


def test_neighbours_of_very_large_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1e200, 1e199]), (4, [-1e200, 0.0]), (5, [1e308, 1e308]), (6, [-1e308, 1e308]), (100, [3.0, 4.0])]
    found = sorted(tuple(r) for r in ann_tree.every_hundredth(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    mine = [(r[2], r[3]) for r in found if r[0] == 0]
    assert [v for v, _ in mine] == [1, 2, 3, 100, 4, 5, 6] and [s for _, s in mine[:2]] == [1.0, 2.0]
    assert mine[2][1] == pytest.approx(1e199) and mine[4][1] == pytest.approx(2e200)
    assert len([r for r in found if r[0] == 100]) == 7
