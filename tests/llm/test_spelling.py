"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from vectorloom.llm import spelling

DOCS = "doc_id long, text string, word string, n int, cell long, form string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, 2, "f") for d, t in rows], DOCS)


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def apart(a, b):
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    words = words_of(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and apart(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def made(seed, n_words=12):
    """Words, their misspellings, and texts in which the former are far more frequent."""
    r = random.Random(seed)
    base = ["".join(r.choices("aeinrstlüé", k=r.randint(7, 11))) for _ in range(n_words)]
    texts = []
    for doc in range(160):
        out = []
        for _ in range(12):
            w = r.choice(base[: 1 + int(n_words * r.random() ** 3)])
            if r.random() < 0.12:
                at, kind = r.randrange(len(w)), r.random()
                w = w[:at] + ("" if kind < 0.3 else r.choice("aeinü")) + w[at + (kind < 0.7) :]
            out.append(w.capitalize() if r.random() < 0.2 else w)
        texts.append((doc, r.choice([" ", ", ", "\n", "1", "-"]).join(out)))
    return texts


@pytest.mark.parametrize(("seed", "cell_words", "pairs"), [(1, 40_000, 4_000_000), (2, 5, 10), (3, 1, 1)])
def test_variants(spark, monkeypatch, seed, cell_words, pairs):
    for name, value in (("CELL_WORDS", cell_words), ("MEAN_CELL", max(2, cell_words // 100)), ("PAIRS", pairs), ("COUNTED", 50 if seed > 1 else 400_000)):
        monkeypatch.setattr(spelling, name, value)
    rows = made(seed) + [(None, "nulligkeit nulligkeit nulligkeitt nulligkeitt"), (500, None), (501, ""), (502, "short x")]
    want = brute(rows)
    found = {r["word"]: tuple(r)[1:] for r in spelling.variants(documents(spark, rows)).collect()}
    assert found == want
    assert sum(f is not None for f, *_ in want.values()) >= 3


def test_chains_and_ties(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ONE_OF", 2**40)
    rows = [(1, "aaaaaaa " * 2 + "aaaaaab " * 20 + "aaaaabb " * 200 + "aaaabbb " * 2000), (2, "zzzzzzz " * 2 + "zzzzzzy " * 20 + "zzzzzzx " * 20), (3, "É×÷eeeee " * 3 + "é×÷eeeee " * 30)]
    found = {r["word"]: tuple(r)[1:] for r in spelling.variants(documents(spark, rows)).collect()}
    assert found["aaaaaaa"] == ("aaaaaab", "aaaabbb", 2, 1, 20)
    assert found["aaaabbb"] == (None, "aaaabbb", 2000, 1, None)
    assert found["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2, 2, 20)
    assert found["É×÷eeeee"] == ("é×÷eeeee", "é×÷eeeee", 3, 1, 30)


def test_long_words_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ONE_OF", 2**40)
    long = "ab" * 20_000
    rows = [(1, f"{long} {long} " * 10), (2, f"{long}c {long}c {long[:-1]}x {long[:-1]}x {long[::-1]} {long[::-1]}")]
    found = {r["word"]: (r["form"], r["n"], r["n_near"]) for r in spelling.variants(documents(spark, rows)).collect()}
    assert found == {long: (None, 20, 2), long + "c": (long, 2, 1), long[:-1] + "x": (long, 2, 1), long[::-1]: (None, 2, 0)}
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None)])).count() == 0


def test_one_edit_is_an_edit_distance_of_one():
    r = random.Random(9)
    words = ["".join(r.choices("abé", k=r.randint(1, 6))) for _ in range(120)]
    for a in words:
        for b in words:
            assert spelling.one_edit(a, b) == (apart(a, b) == 1)
    x = spelling.Words(words, spelling.np.ones(len(words), int), spelling.np.zeros(len(spelling.ALPHABET), int))
    i, j = (v.ravel() for v in spelling.np.meshgrid(range(len(words)), range(len(words))))
    right = spelling.verified(x, i, x, j)
    close = [abs(len(x.words[a]) - len(x.words[b])) <= 1 for a, b in zip(i, j, strict=True)]
    assert [bool(v) for v, c in zip(right, close, strict=True) if c] == [apart(x.words[a], x.words[b]) == 1 for a, b, c in zip(i, j, close, strict=True) if c]


def test_ways_between_cells_are_all_different():
    for k in range(1, spelling.FINE + 1):
        for values in (spelling.GROUP_VALUE[:k], spelling.GROUP_VALUE[spelling.FINE : spelling.FINE + k]):
            forth, back = spelling.steps(values)
            assert len({0, *forth, *back}) == 1 + len(forth) + len(back) == 1 + 2 * k + k * (k - 1)
