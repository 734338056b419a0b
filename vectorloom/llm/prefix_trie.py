"""The trie of conversation prefixes, its subtree totals by time-forward processing.

Conversations are rebuilt first (``rebuilt``): those of five consecutive numbers may share the head of
the first. Each turn is known by 128 bits of a digest of role and text, and each prefix by two sums over its
turns, which are the same wherever a prefix stands; texts themselves aren't shuffled. Turns are numbered
and summed by a scan over ranges (``plans.ranges``), so a conversation of any length is no task of its
own.

Prefixes are grouped to nodes, counting members as they are shuffled. Nodes of one smallest member and
one number of members follow one another, without a branch or an end between: such chains count as one
node, at the place of their lowest. Nodes are then handled in reverse level order, sorted outside of
memory by Spark: each takes what its children have sent to its place in time from a priority queue that
spills (``TimeQueue``), and sends its totals forward to its parent's place. This happens within shards:
chains of over ``heavy`` members, their number divided by the tasks, stay out; the subtrees below, of at
most twice ``heavy`` chains each, are dealt by their roots' prefixes. Then it happens across shard roots:
their totals, summed for each parent while they are shuffled, go up the heavy chains. On a path each heavy
chain has fewer members than the one above, and members that leave it later are longer, so P of them
take P squared / 2 turns: they are few in any table and are handled as one sorted stream. A last scan over
ranges gives each node of a chain its share.

A node's ends are digested as a stream: ids are sorted over ranges, put into strings of up to ``CHUNK`` ids, and
the strings of one node go through its digest one after the other; memory doesn't grow with their number.

Defined results: rows without conv_id are left out; turns of one number go by role, then by the SHA-256
of role and text; repeated rows are turns of their own; negative conversations count down
to the next multiple of five; texts are of any length; no conversations, no root; further columns are
ignored. Different prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from typing import IO, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranges import PART, carried, ranged
from ..plans.staging import partitions, stage, unstage

#: Conversations that share a head, and turns of it at most.
SHARE, HEAD = 5, 8
#: Members of a heavy chain, at least; turns of one conversation joined in one piece.
LEAST_HEAVY, PIECE = 100, 4096
#: A heavy chain's copies, among which the turns below it are dealt.
SALTS = 64
#: Messages of a queue in memory, and of a spilled run read at once.
IN_MEMORY, READ = 100_000, 1000
#: Ids in one string of a node's ends.
CHUNK = 4096
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NOTHING = hashlib.sha256(b"").hexdigest()
RANKED = "conv_id long, rank long, s1 long, s2 long, p1 long, p2 long, bytes long"
TOTALS = "conv_id long, n_convs long, bottom long, top long, n_children long, n_leaves long, below long, total long, parent_conv_id long, outside boolean, q1 long, q2 long"


def power(way: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of a base modulo 2 ** 64; exponents may be negative."""
    base = BASES[way]
    up = np.power(np.uint64(base), np.maximum(exponents, 0).astype(np.uint64))
    return up * np.power(np.uint64(pow(base, -1, 2**64)), np.maximum(-exponents, 0).astype(np.uint64))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sums_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [column(batch, n).astype(np.int64).view(np.uint64) for n in names]


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    cast = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(cast, kinds, strict=True)], list(names))


def ranked(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn with its rank within its conversation and the sums of the prefixes with it and before it; and the staged table that it reads."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), told.alias("told"), F.octet_length(text).cast("long").alias("bytes")).filter(F.col("conv_id").isNotNull())
    dealt = ranged(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("told")], partitions(conversations.sparkSession))
    schema = f"{PART} int, conv_id long, rank long, s1 long, s2 long, h1 long, h2 long, bytes long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rank, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not len(batch):
                continue
            convs = column(batch, "conv_id")
            told = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("told")).to_pylist()), "<u8").reshape(len(convs), 4)
            begins = np.concatenate([[convs[0] != conv or conv is None], convs[1:] != convs[:-1]])
            start = np.maximum.accumulate(np.where(begins, np.arange(len(convs)), 0))
            going = ~np.logical_or.accumulate(begins)
            ranks = np.arange(len(convs)) - start + 1 + going * rank
            out = []
            for way in range(2):
                total = np.cumsum(told[:, way] * power(way, ranks), dtype=np.uint64)
                before = np.where(start > 0, total[start - 1], np.uint64(0))
                out.append(total - np.where(going, np.uint64(0), before) + np.where(going, sums[way], np.uint64(0)))
            yield batch_of(schema, [column(batch, PART), convs, ranks, *out, told[:, 0].copy(), told[:, 1].copy(), column(batch, "bytes")])
            conv, rank, sums = convs[-1], ranks[-1], [o[-1] for o in out]

    staged = stage(dealt.select("conv_id", "told", "bytes", PART).mapInArrow(scan, schema), "trie-turns")
    ends = staged.groupBy(PART).agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "rank", "s1", "s2")).alias("last")).collect()  # one row a part

    def join(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        return a[0] + b[0], *((a[w + 1] + b[w + 1] * pow(BASES[w], a[0], 2**64)) % 2**64 for w in range(2))

    begun = carried([(e[PART], e["first"], e["last"]["conv_id"], (e["last"]["rank"], e["last"]["s1"] % 2**64, e["last"]["s2"] % 2**64)) for e in ends], join)

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, convs, ranks = column(batch, PART), column(batch, "conv_id"), column(batch, "rank").copy()
            sums, own = sums_of(batch, "s1", "s2"), sums_of(batch, "h1", "h2")
            for part in np.unique(parts).tolist():
                if part in begun:
                    conv, (rank, *earlier) = begun[part]
                    mine = (parts == part) & (convs == conv)
                    for way in range(2):
                        sums[way] = np.where(mine, sums[way] * power(way, np.array([rank])) + np.uint64(earlier[way]), sums[way])
                    ranks[mine] += rank
            yield batch_of(RANKED, [convs, ranks, *sums, *(s - h * power(w, ranks) for w, (s, h) in enumerate(zip(sums, own, strict=True))), column(batch, "bytes")])

    return staged.mapInArrow(complete, RANKED), staged


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, prefix sums, those before, bytes) and the conversations (conv_id, length, sums of the whole)."""
    head = F.when(F.col("rank") <= HEAD, F.struct("rank", "s1", "s2", "p1", "p2", "bytes"))
    convs = stage(turns.groupBy("conv_id").agg(F.max("rank").alias("n"), F.array_sort(F.collect_list(head)).alias("head"), F.max_by(F.struct("s1", "s2"), "rank").alias("whole")), "trie-conversations")
    conv = F.col("conv_id")
    heads = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")
    host = convs.select(F.col("conv_id").alias("host"), F.col("head").alias("host_head"))
    taken = F.least(F.col("h"), F.coalesce(F.size("host_head"), F.lit(0)))
    guests = convs.withColumn("h", heads).withColumn("host", conv - F.pmod(conv, F.lit(SHARE))).join(host, "host", "left").withColumn("k", F.when(F.col("host_head").isNull(), 0).otherwise(taken))

    def sums_at(array: str, at: str) -> Column:
        found = F.get(array, F.col(at) - 1)
        return F.struct(*[F.coalesce(found[s], F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")])

    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    guests = stage(guests.select("conv_id", "n", "h", "k", length.cast("long").alias("length"), sums_at("host_head", "k").alias("host_sums"), sums_at("head", "h").alias("own_sums"), "whole", F.slice("host_head", 1, F.col("k")).alias("shared")), "trie-guests")
    unstage(convs)
    shared = guests.select("conv_id", F.explode("shared").alias("t")).select("conv_id", F.col("t.rank").alias("depth"), "t.s1", "t.s2", "t.p1", "t.p2", "t.bytes")
    # a conversation's own turns meet it in pieces, so that a long one is no key of its own
    pieces = guests.filter(F.col("n") > F.col("h")).select("conv_id", "h", "k", "host_sums", "own_sums", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    own = turns.withColumn("piece", F.floor((F.col("rank") - 1) / PIECE)).join(pieces, ["conv_id", "piece"]).filter(F.col("rank") > F.col("h"))
    own = own.select("conv_id", "rank", "s1", "s2", "p1", "p2", "bytes", "h", "k", *[F.col(f"{a}.s{w}").alias(f"{a}{w}") for a in ("host_sums", "own_sums") for w in (1, 2)])
    schema = "conv_id long, depth long, s1 long, s2 long, p1 long, p2 long, bytes long"

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over own turns, moved to their places below the head."""
        for batch in batches:
            shift = column(batch, "k").astype(np.int64) - column(batch, "h")
            out = []
            for kind in ("s", "p"):
                for way in range(2):
                    mine, theirs, mine_at_h = sums_of(batch, f"{kind}{way + 1}", f"host_sums{way + 1}", f"own_sums{way + 1}")
                    out.append(theirs + (mine - mine_at_h) * power(way, shift))
            yield batch_of(schema, [column(batch, "conv_id"), column(batch, "rank") + shift, *out, column(batch, "bytes")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k, n = (column(batch, c).astype(np.int64) for c in ("h", "k", "n"))
            out = []
            for way in range(2):
                mine, theirs, mine_at_h = sums_of(batch, f"whole{way + 1}", f"host_sums{way + 1}", f"own_sums{way + 1}")
                out.append(np.where(n > h, theirs + (mine - mine_at_h) * power(way, k - h), theirs))
            yield batch_of("conv_id long, length long, s1 long, s2 long", [column(batch, "conv_id"), column(batch, "length"), *out])

    ends = guests.select("conv_id", "n", "h", "k", "length", *[F.col(f"{a}.s{w}").alias(f"{a}{w}") for a in ("host_sums", "own_sums", "whole") for w in (1, 2)])
    return shared.unionByName(own.mapInArrow(moved, schema)), ends.mapInArrow(whole, "conv_id long, length long, s1 long, s2 long")


class TimeQueue:
    """A priority queue of messages (time, content) whose times are taken in rising order; beyond ``IN_MEMORY`` it spills sorted runs.

    The runs lie in temporary files of the task's own worker, as Spark's spills do; they go with the
    queue, and a task that is run again makes them anew.
    """

    def __init__(self):
        self.heap: list[tuple] = []
        self.count = 0
        self.heads: list[tuple] = []  # the next message of each run, with the run
        self.runs: list[Iterator[tuple]] = []

    def send(self, time: tuple, content: Any) -> None:
        self.count += 1
        heapq.heappush(self.heap, (time, self.count, content))
        if len(self.heap) > IN_MEMORY:
            self.spill()

    def spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        for k in range(0, len(self.heap), READ):
            pickle.dump(self.heap[k : k + READ], file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self.heap = []
        self.runs.append(self.read(file))
        self.advance(len(self.runs) - 1)

    @staticmethod
    def read(file: IO[bytes]) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def advance(self, run: int) -> None:
        if (message := next(self.runs[run], None)) is not None:
            heapq.heappush(self.heads, (*message[:2], run, message[2]))

    def take(self, time: tuple) -> Iterator[Any]:
        """What has been sent to a time, taking it from the queue."""
        while self.heap and self.heap[0][0] == time:
            yield heapq.heappop(self.heap)[2]
        while self.heads and self.heads[0][0] == time:
            _, _, run, content = heapq.heappop(self.heads)
            self.advance(run)
            yield content


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains in reverse level order to their totals; a chain's row leaves when its parent has taken its message.

    A chain stands at the time of its lowest node. Columns: (bottom, b1, b2) the time, top, the parent's prefix
    (q1, q2), conv_id, n_convs, saved (its own), what it has got from elsewhere (got_children, got_leaves, got_saved),
    parent_conv_id and outside: whether the parent is elsewhere or there is none.
    """
    queue, out = TimeQueue(), []
    for batch in batches:
        for x in batch.to_pylist():
            children, leaves, below = x["got_children"], x["got_leaves"], x["got_saved"]
            for row in queue.take((-x["bottom"], x["b1"], x["b2"])):
                children, leaves, below = children + 1, leaves + row[5], below + row[7]
                out.append((*row[:8], x["conv_id"], *row[9:]))
            row = (x["conv_id"], x["n_convs"], x["bottom"], x["top"], children, leaves or 1, below, below + x["saved"], x["parent_conv_id"], x["outside"], x["q1"], x["q2"])
            if x["outside"]:
                out.append(row)
            else:
                queue.send((1 - x["top"], x["q1"], x["q2"]), row)
            if len(out) >= 5000:
                yield batch_of(TOTALS, list(zip(*out, strict=True)))
                out = []
    if out:
        yield batch_of(TOTALS, list(zip(*out, strict=True)))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ends: (s1, s2, depth, ends_sha256), of nodes that have any."""
    parts = partitions(ends.sparkSession)
    schema, key = "s1 long, s2 long, depth long, first long, ids string", ["s1", "s2", "depth"]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != node or len(ids) >= CHUNK:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = now, []
                ids.append(conv)
            if len(out) >= 500:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    digest_schema = "s1 long, s2 long, depth long, ends_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 5000:
                yield batch_of(digest_schema, list(zip(*out, strict=True)))
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield batch_of(digest_schema, list(zip(*out, strict=True)))

    by = [*map(F.col, key), F.col("conv_id")]
    chunks = ends.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(strings, schema)
    return chunks.repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(digest, digest_schema)


def nodes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The distinct prefixes: depth, sums, those of the parent, smallest member, members, bytes of the last text."""
    zero = F.lit(0).cast("long")
    grouped = turns.groupBy("depth", "s1", "s2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter(F.col("n_convs") > 0)
    return grouped.unionByName(root.select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2")))


def chain_totals(turns: DataFrame, nodes: DataFrame, n_convs: int) -> DataFrame:
    """The totals of every chain (``TOTALS``)."""
    spark = nodes.sparkSession
    parts = partitions(spark)
    heavy_from = max(LEAST_HEAVY, n_convs // (4 * parts))
    lowest, highest = F.max_by(F.struct("s1", "s2"), "depth"), F.min_by(F.struct("p1", "p2"), "depth")
    zero = F.lit(0).cast("long")
    chains = nodes.groupBy("conv_id", "n_convs").agg(F.max("depth").alias("bottom"), F.min("depth").alias("top"), F.sum((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), lowest.alias("b"), highest.alias("q"))
    chains = stage(chains.select("conv_id", "n_convs", "bottom", "top", "saved", F.col("b.s1").alias("b1"), F.col("b.s2").alias("b2"), F.col("q.p1").alias("q1"), F.col("q.p2").alias("q2")), "trie-chains")
    heavy = chains.filter(F.col("n_convs") > heavy_from) if n_convs > heavy_from else chains.filter(F.col("top") == 0)
    light = chains.join(heavy.select("conv_id", "n_convs"), ["conv_id", "n_convs"], "left_anti")
    # where each conversation leaves the heavy chains: its deepest turn below one
    above = heavy.select(F.col("b1").alias("p1"), F.col("b2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    leaving = turns.select("conv_id", "depth", "s1", "s2", "p1", "p2", salt.alias("salt")).join(above, ["p1", "p2", "salt"])
    leaving = leaving.groupBy("conv_id").agg(F.max_by(F.struct("depth", "s1", "s2", "parent_conv_id"), "depth").alias("at"))
    got = [zero.alias(c) for c in ("got_children", "got_leaves", "got_saved")]
    dealt = light.join(leaving, "conv_id").withColumn("outside", F.col("top") == F.col("at.depth")).select("conv_id", "n_convs", "bottom", "top", "saved", "b1", "b2", "q1", "q2", *got, F.when(F.col("outside"), F.col("at.parent_conv_id")).alias("parent_conv_id"), "outside", F.col("at.s1").alias("piece1"), F.col("at.s2").alias("piece2"))
    order = [F.col("bottom").desc(), F.col("b1"), F.col("b2")]
    within = stage(dealt.repartition(parts, "piece1", "piece2").sortWithinPartitions(*order).mapInArrow(forward, TOTALS), "trie-shards")
    sent = within.filter("outside").groupBy("q1", "q2").agg(F.count("*").alias("got_children"), F.sum("n_leaves").alias("got_leaves"), F.sum("total").alias("got_saved")).select(F.col("q1").alias("b1"), F.col("q2").alias("b2"), "got_children", "got_leaves", "got_saved")
    filled = [F.coalesce(c, zero).alias(c) for c in ("got_children", "got_leaves", "got_saved")]
    roots = heavy.join(sent, ["b1", "b2"], "left").select("conv_id", "n_convs", "bottom", "top", "saved", "b1", "b2", "q1", "q2", *filled, F.lit(None).cast("long").alias("parent_conv_id"), (F.col("top") == 0).alias("outside"))
    across = stage(roots.repartition(1).sortWithinPartitions(*order).mapInArrow(forward, TOTALS), "trie-roots")
    unstage(chains)
    return within.unionByName(across)


def expanded(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Every node with its own totals: its chain's, and what the chain has saved from it downwards."""
    none = F.lit(None).cast("long")
    facts = ["bottom", "top", "n_children", "n_leaves", "below", "parent_conv_id"]
    first = totals.select("conv_id", "n_convs", F.lit(-(2**62)).cast("long").alias("back"), none.alias("saved"), none.alias("s1"), none.alias("s2"), *facts)
    rest = nodes.select("conv_id", "n_convs", (-F.col("depth")).alias("back"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "s1", "s2", *[none.alias(c) for c in facts])
    dealt = ranged(first.unionByName(rest), [F.col("conv_id"), F.col("n_convs"), F.col("back")], partitions(nodes.sparkSession))
    names = ["conv_id", "n_convs", "back", "s1", "s2", "running", *facts]
    schema = ", ".join(f"{n} long" for n in names) + f", known boolean, last boolean, {PART} int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a part: each node with what its chain has saved up to it, and its chain's facts if they stand in the part."""
        chain, known, running, out, held, part = None, None, 0, [], None, None
        for batch in batches:
            for conv, n, back, saved, s1, s2, *given, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, n) != chain:
                    chain, known, running = (conv, n), None, 0
                if saved is None:
                    known, row = given, (conv, n, None, None, None, 0, *given, True)
                else:
                    running += saved
                    row = (conv, n, back, s1, s2, running, *(known or [None] * len(facts)), known is not None)
                if held is not None and held[2] is not None:
                    out.append((*held, False, part))
                held = row
            if len(out) >= 5000:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if held is not None:  # the last row stays even if it is no node: it tells what the next part starts from
            out.append((*held, True, part))
            yield batch_of(schema, list(zip(*out, strict=True)))

    columns = ["conv_id", "n_convs", "back", "saved", "s1", "s2", *facts, PART]
    staged = stage(dealt.select(*columns).mapInArrow(scan, schema), "trie-expanded")
    firsts = {r[PART]: tuple(r["first"]) for r in staged.groupBy(PART).agg(F.min(F.struct("conv_id", "n_convs")).alias("first")).collect()}  # one row a part
    ends = staged.filter("last").collect()  # one row a part

    def join(a: tuple, b: tuple) -> tuple:
        return (b[0] if b[0] is not None else a[0], a[1] + b[1])

    begun = carried([(e[PART], firsts[e[PART]], (e["conv_id"], e["n_convs"]), ([e[f] for f in facts] if e["known"] else None, e["running"])) for e in ends], join)
    rows = [(part, *chain, running, *(known or [None] * len(facts))) for part, (chain, (known, running)) in begun.items()]
    earlier = nodes.sparkSession.createDataFrame(rows, f"{PART} int, conv_id long, n_convs long, earlier long, " + ", ".join(f"e_{f} long" for f in facts))
    whole = staged.filter(F.col("back").isNotNull()).join(F.broadcast(earlier), [PART, "conv_id", "n_convs"], "left")  # at most one row a part
    fact = {f: F.when(F.col("known"), F.col(f)).otherwise(F.col(f"e_{f}")) for f in facts}
    depth = -F.col("back")
    inner = depth > fact["top"]
    return whole.select(
        "conv_id", depth.alias("depth"), "s1", "s2",
        F.when(inner, F.col("conv_id")).otherwise(fact["parent_conv_id"]).alias("parent_conv_id"), "n_convs",
        F.when(depth == fact["bottom"], fact["n_children"]).otherwise(F.lit(1).cast("long")).alias("n_children"),
        fact["n_leaves"].alias("n_leaves"), (fact["below"] + F.col("running") + F.coalesce("earlier", F.lit(0).cast("long"))).alias("saved_tokens"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, scanned = ranked(conversations)
    turns, convs = rebuilt(turns)
    turns, convs = stage(turns, "trie-rebuilt"), stage(convs, "trie-ends")
    unstage(scanned)
    nodes = stage(nodes_of(turns, convs), "trie-nodes")
    totals = chain_totals(turns, nodes, convs.count())
    whole = expanded(nodes, totals)
    unstage(turns, nodes)
    ends = digests_of_ends(convs.withColumnRenamed("length", "depth"))
    return whole.join(ends, ["s1", "s2", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
