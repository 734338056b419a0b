"""Secret scans: patterns, and character Markov models of random strings and identifiers.

Three patterns give the base spans. On top of them, each unbroken run of ``LEAST`` or more key
characters is scored by the mean, over its adjacent character pairs, of the log-likelihood ratio
between a Markov model of random strings and one of ordinary identifiers. Both models are counts of
character pairs over labelled samples; the threshold lies between the classes' scores on them, and as
short runs score less surely, runs below ``LONG`` have a threshold of their own, from samples cut to
such lengths, and need a letter and a digit: numbers and long words are too like random strings there. A run above its threshold that overlaps no base span becomes a span of kind ``random``.
So does a part of ``LEAST`` or more letters and digits between separators, as in a path, whose run as a
whole is none.

Everything is a DataFrame expression over one row at a time: no shuffle, no Python on executors. To
the driver come only the pair counts, at most two for each pair of the 67 symbols.

Positions are code points, the end exclusive. Defined results: a null text counts as empty; texts
without matches have no spans; texts of any length are scanned whole; repeated rows get a row each; an
empty table gives no rows; further columns are ignored. A sample with one class alone is refused with
ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import private

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Fixed values. A hex or access run is maximal, so asking for its least length in the pattern
#: drops the same runs as measuring it afterwards.
PATTERNS = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
LEAST_VALUE, LEAST, LONG = 6, 16, 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: A part of a longer run: letters and digits with a separator at one end at least.
PART = rf"(?<=[/_=-])[A-Za-z0-9+]{{{LEAST},}}|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+]{{{LEAST},}}+(?=[/_=-])"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(SYMBOLS)
SAMPLES = 4000
#: Parts of ordinary identifiers and long words.
PARTS = (
    "get set user name file path index value count list item data node type table column row key text line word page view model "
    "test main init load save read write open close send recv parse format build make update delete create remove insert select "
    "config option default service client server request response message event handler manager factory builder context session "
    "string number integer double array object class method function return import export module package version release public "
    "information international representation development environment government communication organisation understanding "
    "administration responsibility characteristic verantwortung gesellschaft wissenschaft geschichte entwicklung moeglichkeit "
    "naturellement developpement gouvernement connaissance generalmente posibilidad conocimiento universidad desarrollo"
).split()
SPAN = "struct<start:int,rank:int,end:int>"
#: Steps that grow one array.
BLOCK = 128


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of character pairs, row by row over SYMBOLS, and the least means of long and of short secrets."""

    ratios: tuple[float, ...]
    threshold: float
    short: float


def constant(values, kind: str) -> Column:
    """An array that Spark folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def code(symbol: Column) -> Column:
    """The place of a character among SYMBOLS."""
    places = [SYMBOLS.find(chr(c)) for c in range(128)]
    return F.get(constant(places, "int"), F.ascii(symbol))


def mean_ratio(run: Column, ratios: tuple[float, ...]) -> Column:
    """The mean log-likelihood ratio of a run's character pairs."""
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("pairs"))

    def step(s: Column, c: Column) -> Column:
        first = s["last"] < 0
        ratio = F.get(constant(ratios, "double"), F.greatest(s["last"], F.lit(0)) * K + code(c))
        return F.struct(code(c).alias("last"), (s["sum"] + F.when(first, 0.0).otherwise(ratio)).alias("sum"), (s["pairs"] + F.when(first, 0).otherwise(1)).alias("pairs"))

    letters = F.array_remove(F.split(run, ""), "")
    return F.aggregate(letters, zero, step, lambda s: s["sum"] / F.greatest(s["pairs"], F.lit(1)))


def labelled_samples(spark: SparkSession, rows: int = SAMPLES) -> DataFrame:
    """(token, is_random): strings of hashed numbers in usual encodings, and identifiers of PARTS."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    form = F.col("id") % 5
    random = F.when(form == 0, F.substring(digest, 1, 40)).when(form == 1, b64).when(form == 2, F.translate(b64, "+/=", "xQ7")).when(form == 3, F.translate(b64, "+/=", "-_")).otherwise(F.upper(F.translate(b64, "+/=", "K3P")))
    part = lambda k: F.get(F.split(F.lit(" ".join(PARTS)), " "), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int"))
    words = [part(k) for k in range(4)]
    joined = [F.concat_ws(s, *words) for s in ("_", "-", "/", "")]
    camel = F.concat(words[0], *[F.initcap(w) for w in words[1:]])
    plain = F.when(form == 0, joined[0]).when(form == 1, camel).when(form == 2, joined[3]).when(form == 3, F.concat(joined[1], F.lit("-"), F.col("id") % 100)).otherwise(F.concat(joined[2], F.initcap(part(9))))
    ids = spark.range(rows)
    return ids.select(random.alias("token"), F.lit(True).alias("is_random")).unionByName(ids.select(plain.alias("token"), F.lit(False).alias("is_random")))


def train(samples: DataFrame) -> Model:
    """Markov models from labelled (token, is_random) rows; nulls and other characters are left out."""
    known = samples.select("token", "is_random").dropna()
    pairs = known.select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("token") - 1, F.lit(1))), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = {(r["is_random"], r["pair"]): r["count"] for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("is_random", "pair").count().collect()}
    if len({label for label, _ in counts}) < 2:
        raise ValueError("labelled samples of both classes are needed")
    ratios = []
    for a in SYMBOLS:
        totals = {y: sum(counts.get((y, a + b), 0) for b in SYMBOLS) for y in (True, False)}
        for b in SYMBOLS:
            logs = [math.log((counts.get((y, a + b), 0) + 0.5) / (totals[y] + 0.5 * K)) for y in (True, False)]
            ratios.append(round(logs[0] - logs[1], 5))
    cut = F.substring("token", F.lit(1), LEAST + F.pmod(F.xxhash64("token"), F.lit(LONG - LEAST)).cast("int"))
    score = lambda c: mean_ratio(c, tuple(ratios))
    scored = known.where(F.char_length("token") >= LONG).select("is_random", score(F.col("token")).alias("long"), score(cut).alias("short"))
    between = [F.percentile(F.when(F.col("is_random") == y, F.col(c)), F.lit(q)) for c in ("long", "short") for y, q in ((False, 0.999), (True, 0.01))]
    low, high, low_short, high_short = (v or 0.0 for v in scored.agg(*[b.alias(f"b{k}") for k, b in enumerate(between)]).first())
    # a short run has to be surer than any identifier of the sample
    return Model(tuple(ratios), (low + high) / 2, max((low_short + high_short) / 2, low_short))


def scan(count: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The arrays that step(carry, i) gives beside the next carry, for i from 0 to count - 1, joined.

    An array is copied whenever it grows, so ``BLOCK`` steps grow one of their own, and blocks are joined at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, i: Column) -> Column:
        after, out = step(s["carry"], i)
        return F.struct(after.alias("carry"), F.concat(s["out"], out).alias("out"))

    def block(s: Column, low: Column) -> Column:
        whole = F.aggregate(F.sequence(low, F.least(low + BLOCK, count) - 1), F.struct(s["carry"].alias("carry"), none.alias("out")), one)
        # through transform, so that the block is worked out once
        return F.get(F.transform(F.array(whole), lambda w: F.struct(w["carry"].alias("carry"), F.concat(s["out"], F.array(w["out"])).alias("out"))), F.lit(0))

    lows = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(lows, start, block, lambda s: F.flatten(s["out"]))


def placed(pieces: Column, runs: Column, rank: int, keep=None) -> Column:
    """Spans of the runs between pieces; keep(i) tells which count."""

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        start = at + F.char_length(F.get(pieces, i))
        end = start + F.char_length(F.get(runs, i))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return end, span if keep is None else F.when(keep(i), span).otherwise(F.array().cast(f"array<{SPAN}>"))

    return scan(F.size(runs), F.lit(0), step, SPAN)


def apart(spans: Column, taken: Column) -> Column:
    """Those of disjoint spans that overlap none of ``taken``, in order of their starts.

    Both are gone over once, by start; a span is held until the next one comes, as what begins inside it spoils it.
    """
    mark = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["rank"].alias("rank"))
    both = F.array_sort(F.concat(F.transform(taken, lambda x: mark(x, 0)), F.transform(spans, lambda x: mark(x, 1))))
    none, last = F.array().cast(f"array<{SPAN}>"), F.lit(2**31 - 1)
    close = F.struct(last.alias("start"), F.lit(1).alias("own"), last.alias("end"), F.lit(0).alias("rank"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("rank"), F.lit(False).alias("held"))

    def step(rows: Column, s: Column, i: Column) -> tuple[Column, Column]:
        x = F.get(rows, i)
        mine = x["own"] == 1
        free = mine & (s["reach"] <= x["start"])
        spoilt = ~mine & (x["start"] < s["end"])
        after = F.struct(
            F.when(mine, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])).alias("reach"),
            *[F.when(mine, x[c]).otherwise(s[c]).alias(c) for c in ("start", "end", "rank")],
            F.when(mine, free).otherwise(s["held"] & ~spoilt).alias("held"),
        )
        return after, F.when(mine & s["held"], F.array(F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))).otherwise(none)

    kept = F.transform(F.array(F.concat(both, F.array(close))), lambda rows: scan(F.size(rows), zero, lambda s, i: step(rows, s, i), SPAN))
    return F.when(F.size(spans) > 0, F.get(kept, F.lit(0))).otherwise(none)


def with_spans(documents: DataFrame, model: Model) -> tuple[DataFrame, dict[str, Column]]:
    """The input's columns beside others of private names, and base and added, arrays of (start, rank of kind, end), with a count of each base kind."""
    own, none = private(documents.columns), F.array().cast("array<string>")
    name = lambda c: f"{own}{c}"
    df = documents.withColumn(name("text"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    finds = {**PATTERNS, "random": RUN, "part": PART}
    for kind, pattern in finds.items():
        met = F.col(name("text")).rlike(pattern)
        group = {"assign": ((0, ""), (2, "v"))}.get(kind, ((0, ""),))
        df = df.withColumn(name(f"met_{kind}"), met)
        df = df.withColumns(
            {name(f"pieces_{kind}"): F.when(F.col(name(f"met_{kind}")), F.split(name("text"), pattern, -1)).otherwise(none)}
            | {name(f"runs{v}_{kind}"): F.when(F.col(name(f"met_{kind}")), F.regexp_extract_all(name("text"), F.lit(pattern), F.lit(g))).otherwise(none) for g, v in group}
        )
    long_value = lambda i: F.char_length(F.get(F.col(name("runsv_assign")), i)) >= LEAST_VALUE
    found = {k: placed(F.col(name(f"pieces_{k}")), F.col(name(f"runs_{k}")), r, long_value if k == "assign" else None) for r, k in enumerate(BASE)}
    df = df.withColumns({name(k): c for k, c in found.items()})
    df = df.withColumn(name("base"), F.array_sort(F.concat(*[F.col(name(k)) for k in BASE])))
    for kind in ("random", "part"):
        run = lambda i, k=kind: F.get(F.col(name(f"runs_{k}")), i)
        mixed = lambda i, run=run: (F.char_length(run(i)) >= LONG) | (run(i).rlike("[0-9]") & run(i).rlike("[A-Za-z]"))
        likely = lambda i, run=run, mixed=mixed: mixed(i) & (mean_ratio(run(i), model.ratios) > F.when(F.char_length(run(i)) < LONG, model.short).otherwise(model.threshold))
        df = df.withColumn(name(kind), placed(F.col(name(f"pieces_{kind}")), F.col(name(f"runs_{kind}")), len(BASE), likely))
    df = df.withColumn(name("whole"), apart(F.col(name("random")), F.col(name("base"))))
    df = df.withColumn(name("added"), F.concat(name("whole"), apart(F.col(name("part")), F.concat(name("base"), name("random")))))
    return df, {c: F.col(name(c)) for c in ("base", "whole", "added")} | {k: F.size(name(k)).cast("bigint") for k in BASE}


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    model = model or train(labelled_samples(documents.sparkSession))
    df, found = with_spans(documents.select("doc_id", "text"), model)
    return df.select("doc_id", *[found[k].alias(f"n_{k}") for k in BASE], F.sha2(listed(found["base"]), 256).alias("base_sha256"), listed(F.array_sort(F.concat(found["base"], found["added"]))).alias("spans"))


def masked_pieces(text: Column, spans: Column, mask: str) -> Column:
    """What is left of a text around spans in order of their starts, with a mask for each group of spans that overlap.

    Code points are counted from a string's beginning, so each ``BLOCK`` spans are cut from a piece of their own.
    """
    none, size = F.array().cast("array<string>"), F.size(spans)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))

    def block(s: Column, low: Column) -> Column:
        mine = F.slice(spans, low + 1, F.lit(BLOCK))
        upto = F.greatest(s["at"], F.array_max(F.transform(mine, lambda x: x["end"])))
        piece = F.substring(text, s["at"] + 1, upto - s["at"])

        def cut(piece: Column) -> Column:
            def one(t: Column, x: Column) -> Column:
                before = F.substring(piece, t["at"] - s["at"] + 1, F.greatest(x["start"] - t["at"], F.lit(0)))
                return F.struct(F.greatest(t["at"], x["end"]).alias("at"), F.when(x["start"] >= t["at"], F.concat(t["out"], F.array(before, F.lit(mask)))).otherwise(t["out"]).alias("out"))

            return F.aggregate(mine, F.struct(s["at"].alias("at"), none.alias("out")), one, lambda t: t["out"])

        return F.struct(upto.alias("at"), F.concat(s["out"], F.transform(F.array(piece), cut)).alias("out"))

    lows = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lows, zero, block, lambda s: F.concat(F.flatten(s["out"]), F.array(F.substring(text, s["at"] + 1, F.char_length(text)))))


def redact(documents: DataFrame, model: Model | None = None, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every span replaced by a mask, with the columns that came in; n_chars follows."""
    model = model or train(labelled_samples(documents.sparkSession))
    own = private(documents.columns)
    spans, masked = f"{own}spans", f"{own}masked"
    df, found = with_spans(documents, model)
    df = df.withColumn(spans, F.array_sort(F.concat(found["base"], found["added"])))
    whole = F.array_join(masked_pieces(F.col("text"), F.col(spans), mask), "")
    df = df.withColumn(masked, F.when(F.size(spans) > 0, whole).otherwise(F.col("text")))
    changed = {"text": F.col(masked), "n_chars": F.when(F.size(spans) > 0, F.char_length(masked).cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in documents.columns else None}
    return df.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"`{c}`") for c in documents.columns])
