"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random

import pytest

from vectorloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.default_file())
    made.no_padding()
    made.no_truncation()
    return made


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.default_file())


def texts_of(seed: int, n: int, names: list[str]) -> list[str]:
    r = random.Random(seed)
    wide = [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x400), *range(0x4E00, 0x4E40), *range(0x1F300, 0x1F340), 0x3A3, 0x130, 0x85, 0x1C, 0x2028, 0x3000]
    kinds = (
        lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 12))),
        lambda: "".join(r.choices("aaab", k=r.randint(1, 90))),
        lambda: "".join(r.choices(names, k=r.randint(1, 4))).replace("</w>", ""),
        lambda: "".join(map(chr, r.choices(wide, k=r.randint(1, 20)))),
        lambda: " ".join(r.choices(["<|endoftext|>", "Don't", "<|startoftext|>ing's", "We'LL 1234", "<|endoftext"], k=r.randint(1, 4))),
    )
    return [r.choice(kinds)() for _ in range(n)]


def test_ids_and_decoded_text_are_the_librarys(vocab, library):
    texts = texts_of(3, 3000, [n for n in vocab.names if n])
    for text, ids in zip(texts, vocab.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert vocab.decode(ids) == library.decode(want, skip_special_tokens=False), text


def test_every_plain_character(vocab, library):
    texts = [f"a{chr(c)}b 1{chr(c)}.{chr(c)}" for low, high in bpe.PLAIN_RANGES for c in range(low, high + 1)]
    assert [i.tolist() for i in vocab.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_compatible_pairs_are_those_that_merging_keeps(vocab):
    """Two tokens are compatible exactly if merging their letters gives them back."""
    r = random.Random(5)
    inner, last = list(vocab.tokens[0].items()), list(vocab.tokens[1].items())
    pairs = [(r.choice(inner), r.choice(last)) for _ in range(3000)]
    short = [t for t in inner if len(t[0]) <= 2], [t for t in last if len(t[0]) <= 2]
    pairs += [(r.choice(short[0]), r.choice(short[1])) for _ in range(3000)]
    import numpy as np

    fits = vocab.compatible(np.array([a for (_, a), _ in pairs]), np.array([b for _, (_, b) in pairs]))
    want = [vocab.merged(x + y) == [a, b] for (x, a), (y, b) in pairs]
    assert fits.tolist() == want and 0 < sum(want) < len(want)


def test_both_ways_to_merge_agree(vocab, monkeypatch):
    r = random.Random(7)
    words = [bytes(r.choices(b"abtheing" if k % 2 else b"aab", k=r.randint(1, 60))) for k in range(500)]
    scanned = [vocab.merged(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [vocab.merged(w) for w in words] == scanned


def test_long_words_and_a_small_cache(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["ab" * 30_000 + " the " + "q" * 3000, "the cat sat on the mat", "the dog and the cat ran", ""] * 2
    assert [vocab.encode([t])[0].tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in vocab.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(vocab.cache) <= 3


def test_digests(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 20)
    texts = {1: "Don't stop", 2: None, 3: "", 4: "x" * 100_000, 5: "naïve Σίσυφος 東京 <|endoftext|>", None: "no id"}
    rows = [(k, t, "ids", 7) for k, t in texts.items()] + [(1, "Don't stop", "again", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.digests(docs).collect()
    assert len(found) == len(rows)
    for f in found:
        ids = library.encode(texts[f["doc_id"]] or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(f)[1:] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    whole = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs).collect()}
    assert whole[2] == whole[3] == (b"", "") and whole[1][1] == "don</w> 't</w> stop</w>"
    assert bpe.digests(docs.limit(0)).count() == 0
