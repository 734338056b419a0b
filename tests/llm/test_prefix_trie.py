"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import zlib

import pytest

from vectorloom.llm import prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, depth long, s1 long"


def conversations(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 0, 1, 2) for c, t, r, x in rows], CONVERSATIONS)


def brute(rows):
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            given.setdefault(conv, []).append((turn is not None, turn or 0, role, told, text))
    given = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in given.items()}
    nodes = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(given.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, len(turns) == d))
    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        children = [k for k in nodes if len(k) == len(key) + 1 and k[:-1] == key] if len(nodes) < 3000 else None
        totals[key] = children
    out = []
    subtotal = {}
    for key in sorted(nodes, key=len, reverse=True):
        children = totals[key]
        members = [c for c, _ in nodes[key]]
        own = (len(members) - 1) * (len(key[-1][1].encode()) if key else 0)
        leaves, saved = sum(subtotal[k][0] for k in children) or 1, own + sum(subtotal[k][1] for k in children)
        subtotal[key] = leaves, saved
        ends = ",".join(map(str, sorted(c for c, end in nodes[key] if end)))
        parent = min(c for c, _ in nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0], r[3]))


def found(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.trie(conversations(spark, rows)).collect()), key=lambda r: (r[1], r[0], r[3]))


def made(seed):
    r = random.Random(seed)
    texts = ["hi", "", None, "é" * 3, "long " * 50]
    rows = []
    for conv in r.sample(range(120), 70):
        for turn in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((conv, turn if r.random() < 0.95 else r.choice([None, 3]), r.choice(["user", "user", "user", None]), texts[int(len(texts) * r.random() ** 3)]))
    rows += [(200 + k, t, "user", "same") for k in range(30) for t in range(12)]
    rows += [(300, t, "user", "same") for t in range(90)] + [(305, t, "user", "same") for t in range(80)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "least", "piece", "memory"), [(1, 1000, 4096, 100_000), (2, 3, 4, 2), (3, 10, 1, 5)])
def test_trie(spark, monkeypatch, seed, least, piece, memory):
    for name, value in (("LEAST_HEAVY", least), ("PIECE", piece), ("IN_MEMORY", memory), ("READ", 1 + memory // 3), ("CHUNK", 1 + memory)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made(seed)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    assert found(spark, []) == found(spark, [(None, 1, "user", "x")]) == []
    rows = [(4, 0, "user", "x")] * 3 + [(0, None, None, None), (1, 0, "a", "y" * 200_000)]
    assert found(spark, rows) == brute(rows)
    # a turnless rebuilt conversation: nothing to share, and no turn of its own after the head
    short = [(c, 0, "user", "x") for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert found(spark, short) == brute(short) and len(brute(short)) == 1


def test_one_long_conversation_lies_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(1500)] + [(10, t, "user", f"t{t % 7}") for t in range(1500)] + [(15, 0, "user", "t0")]
    turns, staged = prefix_trie.ranked(conversations(spark, rows))
    assert staged.filter("conv_id = 5").select("part").distinct().count() > 1
    assert sorted(r["rank"] for r in turns.filter("conv_id = 5").collect()) == list(range(1, 1501))
    assert found(spark, rows) == brute(rows)


def test_queue_takes_messages_in_time(monkeypatch):
    monkeypatch.setattr(prefix_trie, "IN_MEMORY", 7)
    monkeypatch.setattr(prefix_trie, "READ", 3)
    r = random.Random(4)
    queue, waiting, got, want = prefix_trie.TimeQueue(), [], [], []
    for now in range(200):
        for _ in range(r.randint(0, 6)):
            at = now + r.randint(0, 40)
            queue.send((at, 0), (at, len(waiting)))
            waiting.append((at, len(waiting)))
        got.append(sorted(queue.take((now, 0))))
        want.append(sorted(w for w in waiting if w[0] == now))
    assert got == want and queue.runs
