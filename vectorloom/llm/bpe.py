"""Byte-pair encoding and decoding by speculation and verification.

The merges of a vocabulary are never replayed over whole texts. A word's tokens are first proposed by
greedy longest match. A sequence of tokens is what merging gives exactly if merging leaves every two
neighbours as they are (``Vocabulary.compatible``), so all neighbouring pairs of all new words of a
batch are tested at once, in numpy: a pair is taken apart along the boundary, the later merge first,
and fails where the merge across the boundary would have come earlier. Words with a failing pair, and
they alone, are merged exactly (``Vocabulary.merged``). Words met before are looked up in a cache of
bounded size, which changes nothing but time.

Texts are normalised and split as the vocabulary file says. Texts of Latin letters, digits, common
punctuation and controls (``PLAIN``) are lower-cased and split by one pattern, which the tests hold
against the library for every such character; all others go through the file's own normaliser and
splitter. Special tokens in a text are cut out first, as the library does.

Each text is one row of one pass without a shuffle; a text of any length is taken whole.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows give
a row each; an empty table gives no rows; rows without doc_id are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids binary, decoded string"
#: Characters whose normal form, case and class are the same for every Unicode version in use.
PLAIN_RANGES = ((0x00, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E))
PLAIN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in PLAIN_RANGES) + "]*")
#: Words of the cache, and the longest word, in bytes, that goes into it.
CACHE_WORDS, CACHE_BYTES = 600_000, 64
NEVER = int(np.iinfo(np.int64).max)
NO_MERGE = (NEVER, -1)
#: Letters up to which a word is merged by scanning its pairs.
SHORT = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin ones stand for themselves."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def plain_class(kind: str) -> str:
    """The plain characters of a general category's kind, as ranges for a pattern."""
    found = [c for a, b in PLAIN_RANGES for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind]
    cuts = [k for k in range(len(found)) if k == 0 or found[k] != found[k - 1] + 1] + [len(found)]
    return "".join(f"{chr(found[a])}-{chr(found[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False))


class Vocabulary:
    """Tokens, merges and splitting rules of a word-end byte-pair vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, library = given["model"], Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.names = np.empty(max([*ids.values(), *self.special.values()]) + 1, object)
        for name, number in [*ids.items(), *self.special.items()]:
            self.names[number] = name
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        letter, number = plain_class("L"), plain_class("N")
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\t-\r \x85\xa0{letter}{number}]+")
        # a token's rank is that of the merge that makes it; single letters have none
        size = len(self.names)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            self.rank[made], self.left[made], self.right[made] = rank, ids[a], ids[b]
            self.merges[ids[a], ids[b]] = rank, made
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # greedy match proposes only tokens that merging can make
        made = [n for n in ids if len(n.removesuffix(suffix)) == 1 or self.rank[ids[n]] >= 0]
        self.tokens: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}
        for name in made:
            ends = bool(suffix) and name.endswith(suffix)
            self.tokens[ends][bytes(value[c] for c in (name[: -len(suffix)] if ends else name))] = ids[name]
        self.longest = tuple(max(map(len, t)) for t in self.tokens)
        self.cache: dict[str, bytes] = {}

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place; the last one carries the end of the word."""
        (inner, last), (most, most_last) = self.tokens, self.longest
        out, at, n = [], 0, len(word)
        while at < n:
            if n - at <= most_last and (found := last.get(word[at:])) is not None:
                out.append(found)
                break
            end = min(n - 1, at + most)
            while (found := inner.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, ``NEVER`` if it has none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves tokens a and b side by side, for each pair.

        Going back in time, the token made later is taken apart and its part at the boundary stays. Before
        that merge both parts lay side by side, so a merge across the boundary must not have come before
        it: not with a lower rank, nor with the same one if the merge undone lay to the right, since merges
        of one rank go from left to right.
        """
        fits = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        while len(at):
            clash = self.merge_rank(a, b) < limit
            fits[at[clash]] = False
            left, right = self.rank[a], self.rank[b]
            undo_left = left > right
            going = ~clash & (np.maximum(left, right) >= 0)
            at, a, b, left, right, undo_left = (x[going] for x in (at, a, b, left, right, undo_left))
            limit = np.where(undo_left, left, right + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return fits

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, then from left to right; of long words by a heap over linked letters."""
        ids = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n = len(ids)
        if n <= SHORT:
            get = self.merges.get
            ranks = [get(pair, NO_MERGE)[0] for pair in zip(ids, ids[1:], strict=False)]
            while ranks and (least := min(ranks)) < NEVER:
                k = ranks.index(least)
                ids[k : k + 2] = (get((ids[k], ids[k + 1]))[1],)
                del ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], ids[k]), NO_MERGE)[0]
                if k < len(ranks):
                    ranks[k] = get((ids[k], ids[k + 1]), NO_MERGE)[0]
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merges.get((ids[i], ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[j]]))
            if (k := before[i]) >= 0 and (m := self.merges.get((ids[k], ids[i]))):
                heapq.heappush(heap, (m[0], k, ids[k], ids[i]))
        return [x for x in ids if x >= 0]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes: proposed, all neighbours tested at once, and merged where a test fails."""
        proposed = [self.greedy(w) for w in words]
        ids = np.fromiter((x for p in proposed for x in p), np.int64)
        ends = np.cumsum([len(p) for p in proposed])
        inside = np.ones(max(len(ids) - 1, 0), bool)
        inside[ends[:-1] - 1] = False
        pairs, back = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong = np.unique(np.searchsorted(ends, np.flatnonzero(inside)[fails], side="right"))
        whole, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        out = [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k in wrong.tolist():
            merged = self.merged(words[k])
            out[k] = struct.pack(f"<{len(merged)}I", *merged)
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, as characters."""
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        value = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(value[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.split(self.normalise(text))]

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """A text cut at its special tokens: whether a piece is one, and the piece."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(k % 2 == 1, p) for k, p in enumerate(self.special_pattern.split(text)) if p]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [[(special, p if special else self.words(p)) for special, p in self.pieces(t)] for t in texts]
        needed = {w for pieces in split for special, words in pieces if not special for w in words}
        new = list(needed - self.cache.keys())
        found = {w: self.cache[w] for w in needed & self.cache.keys()}
        if new:
            made = dict(zip(new, self.of_words([w.encode("utf-8", "surrogateescape") for w in new]), strict=True))
            if len(self.cache) + len(made) > CACHE_WORDS:
                self.cache = {}
            self.cache.update((w, ids) for w, ids in list(made.items())[:CACHE_WORDS] if len(w) <= CACHE_BYTES)
            found |= made
        look = found.__getitem__
        return [np.frombuffer(b"".join(np.uint32(self.special[p]).tobytes() if special else b"".join(map(look, p)) for special, p in pieces), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ids, special ones too, with a space between: the file names no other decoder."""
        return " ".join(self.names[ids].tolist())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters of text that are encoded at once; one text at least.
AT_ONCE = 1_000_000


def _encoded(documents: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    path = path or default_file()
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.large_string(), "binary": pa.large_binary()}[c.split()[1]] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def rows(docs: list, texts: list[str]) -> list[tuple]:
            return [(doc, *row(vocab, ids)) for doc, ids in zip(docs, vocab.encode(texts), strict=True)]

        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= AT_ONCE:
                    yield batch_of(rows(docs, texts))
                    docs, texts, size = [], [], 0
            yield batch_of(rows(docs, texts))

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Each document's ids, as little-endian unsigned 32-bit integers, and the text that they decode to."""
    return _encoded(documents, path, IDS, lambda v, ids: (ids.tobytes(), v.decode(ids)))


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Each document's token count and the SHA-256 of its ids and of its decoded text."""
    return _encoded(documents, path, ENCODED, lambda v, ids: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
