"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted over whole texts (``count_words``). Each word is a vector of letter counts. One letter
more or less changes the vector by a squared distance of 1, one letter replaced by 2; so words of equal
length are candidates at exactly 2 and words of adjacent lengths at exactly 1. Squared distances of all
pairs of two blocks come from one matrix product, ``|a|^2 + |b|^2 - 2 a.b``, and candidates are verified
on their letters.

Blocks are made by length and by how many letters of each of a few groups a word has (the groups take
frequent letters in turn): one edit changes the length by at most one, adds or takes one letter of
one group, or moves one from a group to another. So a block has all its near words in a fixed set of adjacent
blocks. Few groups, chosen by the number of words, make coarse cells, which are what Spark shuffles;
``FINE`` groups, which refine the coarse ones, make the blocks that are multiplied within a task. A cell
of over ``CELL_WORDS`` words is dealt by hash to several tasks, each of which holds its share and has the
cell's near cells streamed by. What leaves a task is one row a word: how many near words it met and the
best of them.

Defined results: a null or empty text has no words; a null doc_id is written as an empty string where
runs are hashed; repeated rows count once each; words are of any length; among near words of one count
the first in code-point order is the form; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import partitions, stage, unstage

#: Letters of a word at least, its occurrences at least, and how many times as frequent a form is.
LEAST, TWICE, TIMES = 7, 2, 10
#: Of so many runs one loses a letter.
ONE_OF = 31
#: Letter groups that make blocks within a task.
FINE = 8
#: Words of a cell that one task holds, and the words a cell should have on average.
CELL_WORDS, MEAN_CELL = 40_000, 8_000
#: Words counted in a task before they are sent on, and pairs of one matrix product.
COUNTED, PAIRS = 400_000, 4_000_000
#: Letters up to which words are verified in one array.
FLAT = 48
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
LETTER = np.full(256, -1, np.int64)
LETTER[ALPHABET] = np.arange(len(ALPHABET))
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
#: What a letter of each group adds to a cell's number, modulo ``CELLS``. Cells that share a number by
#: chance are compared for nothing; no pair is met twice, since the ways from cell to cell are all different.
CELLS = 2**31 - 1
GROUP_VALUE = np.random.default_rng(20240917).integers(1, CELLS, 2 * FINE, dtype=np.int64)
FOUND = "word string, n_near long, form_n long, form string"


def count_words(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Words of at least ``least`` letters with their occurrences: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def leave() -> Iterator[pa.RecordBatch]:
            words, counts = list(found), list(found.values())
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], ["word", "n"])
            found.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (given := text.as_py()):
                    continue
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for run, n in Counter(RUN.findall(given.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % ONE_OF == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    found[run] += n
                if len(found) > COUNTED:
                    yield from leave()
        yield from leave()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter numbers of all words, one after the other, and where each word begins."""
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return LETTER[np.frombuffer("".join(words).encode("latin-1"), np.uint8)], at


def counts_of(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    letters, at = letters_of(words)
    row = np.repeat(np.arange(len(words)), np.diff(at))
    return np.bincount(row * len(ALPHABET) + letters, minlength=len(words) * len(ALPHABET)).reshape(len(words), len(ALPHABET))


def letter_groups(words: DataFrame) -> np.ndarray:
    """The fine group of each letter: letters in falling order of use, each to the group used least so far."""

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ALPHABET), np.int64)
        for batch in batches:
            total += np.bincount(letters_of(batch.column(0).to_pylist())[0], minlength=len(ALPHABET))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ALPHABET)), pa.int32()), pa.array(total)], ["letter", "n"])

    used = np.zeros(len(ALPHABET), np.int64)
    for r in words.select("word").mapInArrow(use, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():  # one row a letter
        used[r["letter"]] = r["n"]
    group, load = np.zeros(len(ALPHABET), np.int64), np.zeros(FINE, np.int64)
    for letter in np.argsort(-used, kind="stable"):
        group[letter] = load.argmin()
        load[group[letter]] += used[letter]
    return group


def steps(values: np.ndarray) -> tuple[list[int], list[int]]:
    """How an edit may change a cell's number: half of the ways, and the same backwards."""
    ways = [int(v) for v in values]
    ways += [int(values[i] - values[j]) % CELLS for i in range(len(values)) for j in range(i)]
    return ways, [CELLS - w for w in ways]


def coarse_groups(n_words: int, tasks: int) -> int:
    """Groups so many that cells of some ten lengths, about three times as many with each group, have ``MEAN_CELL`` words and are more than the tasks."""
    k, cells = 1, 10
    while k < FINE and (n_words / cells > MEAN_CELL or cells < 2 * tasks):
        k, cells = k + 1, cells * 3
    return k


class Words:
    """Words of one side, in order of their blocks."""

    def __init__(self, words: list[str], n: np.ndarray, group: np.ndarray):
        counts = counts_of(words)
        by_group = np.zeros((len(words), FINE), np.int64)
        for g in range(FINE):
            by_group[:, g] = counts[:, group == g].sum(1)
        cell = by_group @ GROUP_VALUE[:FINE] % CELLS
        order = np.argsort(cell, kind="stable")
        self.words = [words[k] for k in order.tolist()]
        self.n, cell, counts = n[order], cell[order], counts[order]
        self.length = counts.sum(1)
        self.counts = counts.astype(np.float64 if len(words) and self.length.max() > 1000 else np.float32)
        self.square = (self.counts**2).sum(1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
        self.blocks = {int(cell[a]): (int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)}
        self.flat = np.zeros((len(words), FLAT + 2), np.uint8)
        for k, w in enumerate(self.words):
            if len(w) <= FLAT:
                self.flat[k, : len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of the common start, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def verified(x: Words, i: np.ndarray, y: Words, j: np.ndarray) -> np.ndarray:
    """Which candidate pairs are one edit apart."""
    long = np.maximum(x.length[i], y.length[j]) > FLAT
    right = np.zeros(len(i), bool)
    for k in np.flatnonzero(long).tolist():
        right[k] = one_edit(x.words[i[k]], y.words[j[k]])
    at = np.flatnonzero(~long)
    for part in np.array_split(at, len(at) // 100_000 + 1):
        swap = x.length[i[part]] > y.length[j[part]]
        p, q = x.flat[i[part]], y.flat[j[part]]
        p, q = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)  # q is the longer one
        differ = p != q
        first = differ.argmax(1)
        shifted = p[:, :-1] != q[:, 1:]  # equal from the first difference on if q has one letter more
        last = np.where(shifted.any(1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(1), -1)
        same = x.length[i[part]] == y.length[j[part]]
        right[part] = np.where(same, differ.sum(1) == 1, last < first)
    return right


def near_pairs(x: Words, y: Words, ways: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of words of x and of y, block by block of y."""
    for cell, (a, b) in y.blocks.items():
        spans = [span for w in ways if (span := x.blocks.get((cell + w) % CELLS))]
        if not spans:
            continue
        rows = np.concatenate([np.arange(*s) for s in spans])
        high = max(1, PAIRS // len(rows))
        for c in range(a, b, high):
            d = min(b, c + high)
            used = np.flatnonzero(y.counts[c:d].any(0))
            near = x.square[rows][:, None] + y.square[c:d] - 2 * (x.counts[np.ix_(rows, used)] @ y.counts[c:d, used].T)
            i, j = np.nonzero(near <= 2)
            gap = near[i, j]
            i, j = rows[i], j + c
            apart = np.abs(x.length[i] - y.length[j])
            keep = ((apart == 0) & (gap == 2)) | ((apart == 1) & (gap == 1))
            i, j = i[keep], j[keep]
            right = verified(x, i, y, j)
            if right.any():
                yield i[right], j[right]


class Best:
    """For each word of one side, how many near words it has met and the best of them."""

    def __init__(self, size: int):
        self.near, self.n, self.word = np.zeros(size, np.int64), np.zeros(size, np.int64), [""] * size

    def meet(self, mine: np.ndarray, other: Words, theirs: np.ndarray) -> None:
        np.add.at(self.near, mine, 1)
        hopeful = other.n[theirs] >= self.n[mine]
        for k, o in zip(mine[hopeful].tolist(), theirs[hopeful].tolist(), strict=True):
            n, word = int(other.n[o]), other.words[o]
            if n > self.n[k] or n == self.n[k] and word < self.word[k]:
                self.n[k], self.word[k] = n, word

    def rows(self, words: list[str]) -> pa.RecordBatch:
        k = np.flatnonzero(self.near)
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in k.tolist()], pa.string()), pa.array(self.near[k]), pa.array(self.n[k]), pa.array([self.word[i] for i in k.tolist()], pa.string())], ["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """For each word of ``words`` (word, n; distinct) that has one: word, n_near, and the near word of largest n, form, with its form_n."""
    n_words = words.count()
    group, coarse = letter_groups(words), coarse_groups(n_words, partitions(words.sparkSession))
    values = GROUP_VALUE[FINE : FINE + coarse]
    letter_value = values[group % coarse]
    forth, back = steps(values)

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, at = letters_of(batch.column(0).to_pylist())
            sums = np.concatenate([[0], np.cumsum(letter_value[letters])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((sums[at[1:]] - sums[at[:-1]]) % CELLS)], ["word", "n", "cell"])

    celled = stage(words.select("word", "n").mapInArrow(cell_of, "word string, n long, cell long"), "spelling-cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / CELL_WORDS).cast("long").alias("shares"))

    def part(shares: Column, salt: Column) -> Column:
        return F.pmod(salt, shares)

    own = celled.join(sizes, "cell")
    salt = F.xxhash64("word")
    # held: each word once, in its share of its cell; met: each word at all shares of its cell and of the cells an edit leads to
    held = own.select("cell", part(F.col("shares"), salt).alias("share"), F.lit(0).alias("side"), "word", "n")
    to = celled.select(F.explode(F.array(*[F.struct(F.pmod(F.col("cell") - w, F.lit(CELLS)).alias("cell"), F.lit(1 if w == 0 else 2).alias("side")) for w in [0, *forth]])).alias("to"), "word", "n").select("to.*", "word", "n")
    met = to.join(sizes, "cell").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("cell", "share", "side", "word", "n")
    tasks = max(partitions(words.sparkSession), -(-n_words // MEAN_CELL))
    dealt = held.unionByName(met).repartition(tasks, "cell", "share").sortWithinPartitions("cell", "share", "side")
    fine_forth, fine_back = steps(GROUP_VALUE[:FINE])
    everywhere = [0, *fine_forth, *fine_back]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, waiting, best, x = None, [], [], None, None

        def ready() -> None:
            nonlocal x, best, mine
            if x is None:
                x = Words([w for w, _ in mine], np.array([n for _, n in mine], np.int64), group)
                best, mine = Best(len(x.words)), []

        def meet(side: int) -> Iterator[pa.RecordBatch]:
            """Words that wait meet those held; what those of other cells met is sent at once."""
            nonlocal waiting
            ready()
            y = Words([w for w, _ in waiting], np.array([n for _, n in waiting], np.int64), group)
            waiting, theirs = [], Best(len(y.words))
            for i, j in near_pairs(x, y, everywhere):
                best.meet(i, y, j)
                if side == 2:
                    theirs.meet(j, x, i)
            if theirs.near.any():
                yield theirs.rows(y.words)

        side_now = 0
        for batch in batches:
            cells, shares, sides, words_, counts = (c.to_pylist() for c in batch.columns)
            for cell, share, side, word, n in zip(cells, shares, sides, words_, counts, strict=True):
                if (cell, share) != key:
                    if waiting:
                        yield from meet(side_now)
                    if best is not None and best.near.any():
                        yield best.rows(x.words)
                    key, mine, best, x = (cell, share), [], None, None
                elif waiting and (side != side_now or len(waiting) >= CELL_WORDS):
                    yield from meet(side_now)
                side_now = side
                (mine if side == 0 else waiting).append((word, n))
        if waiting:
            yield from meet(side_now)
        if best is not None and best.near.any():
            yield best.rows(x.words)

    found = dealt.select("cell", "share", "side", "word", "n").mapInArrow(compare, FOUND)
    first = F.min(F.struct((-F.col("form_n")).alias("least"), F.col("form")))
    out = stage(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.least")).alias("form_n")), "spelling-near")
    unstage(celled)
    return out


def variants(documents: DataFrame) -> DataFrame:
    """Every word with its form, the last form of its chain (root), its occurrences and near words, and the form's occurrences."""
    words = stage(count_words(documents).filter(F.col("n") >= TWICE), "spelling-words")
    near = near_words(words)
    better = F.col("form_n") >= TIMES * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n"))
    out = stage(joined, "spelling-forms")
    unstage(words, near)
    # each form is TIMES as frequent as the one before, so chains are short; each round doubles what is followed
    reach = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    old = None
    while True:
        after = reach.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = stage(reach.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if old is not None:
            unstage(old)
        old, reach = longer, longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return out.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
