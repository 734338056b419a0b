"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

The units that are judged are the lines of a text and its wrapped paragraphs: runs of two or more lines
without a blank one between (one that holds white space alone is blank), put together. Lines end as on any
system. Distinct word 1- and 2-grams are the features of a logistic regression over licence families and an
unknown class, kept sparse by an L1 penalty, and besides how many words a unit has that the model doesn't
know: a bare name says more about a licence than a name in a sentence about something else. It is trained on
the driver from the templates below, cut and padded at random, from short notices that name a licence,
and from sentences that use licence words or the names of licences without stating one. The least
probability that a family needs is calibrated: of such sentences, made from sources that training doesn't
see, one in a hundred passes. A family also has to be likelier than unknown. All others are ``unknown``. A
family is confirmed when at least ``ALIKE`` of the word 2-grams of one of its templates stand in the unit.

A line gives a row if a family is sure in it or it holds a licence word (``WORDS``). A wrapped paragraph
gives one if a family is sure in it and in none of its lines alone.
Scores are only worked out where they can matter: a unit in which the most that its words can add to any
family's lead, alone and with the word after them, falls short of the least probability can't reach it.
The few words of a text that add anything are found once, and lines and paragraphs add up those they hold.

Scoring is a DataFrame expression over one row at a time: no shuffle, no Python on executors. The
model is a constant of at most ``FEATURES`` rows.

Defined results: a null or empty text has no units; documents without licence paragraphs give no rows;
a text of any length is judged whole; repeated rows are reported each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, ALIKE, COPIES = 1500, 0.6, 40
#: Of the L1 penalty, and of one gradient step.
SPARSE, RATE = 1e-4, 1.0
UNKNOWN = "unknown"
#: Slots that features are looked up by.
SLOTS = 16384
WORDS = r"(?i)licen[cs]|copyright|warrant|redistribut|permission|public domain|all rights|apache|mozilla|\bgnu\b|\bgpl|\bcc[ -]by|creative commons|spdx"
#: Lower-case strings of which every match of ``WORDS`` holds one.
STEMS = ("licenc", "licens", "copyright", "warrant", "redistribut", "permission", "public domain", "all rights", "apache", "mozilla", "gnu", "gpl", "cc by", "cc-by", "creative commons", "spdx")
#: Notices and opening sentences of licence families.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license, see the file LICENSE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("This is free and unencumbered work released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    "Proprietary": ("Copyright, all rights reserved. Unauthorized copying of this file is strictly prohibited.", "Copyright (c) 2020. All rights reserved.", "All rights reserved."),
}
#: Sentences with licence words that state no licence.
ORDINARY = (
    "she renewed her driver license at the office last week",
    "the restaurant lost its liquor license after the inspection",
    "a licensed electrician has to sign the form",
    "the court gave permission to appeal the ruling",
    "he asked permission to leave the room early",
    "the warranty covers repairs for two years",
    "police obtained a warrant to search the house",
    "the lecture explains how copyright came to be",
    "the apache helicopter landed near the village",
    "funds were redistributed among the regions",
    "a fishing licence costs ten pounds a year",
    "the gnu is a large antelope of the plains",
    "all rights of way across the farm remain open",
    "the company sells licences for its patents abroad",
    "students need permission of the school to use the library",
    "the firm holds a public license to sell software and materials",
    "this version of the story was made available by the author",
    "the terms of the agreement were granted without a fee",
    "the general told the public that the program was free",
    "copyright law differs between one country and another",
)
#: Names that licences share with schools, peoples and firms, and sentences in which they stand for these.
NAMES = ("MIT", "Apache", "Mozilla", "BSD", "GNU", "Eclipse", "ISC", "CC", "CC0", "GPL", "EPL", "MPL", "AGPL", "Apache 2.0", "Creative Commons", "CC BY")
MENTIONS = (
    "the {} campus is in the north of the town",
    "students at {} built a small robot",
    "she works for {} as an engineer",
    "a talk about {} was given at the conference",
    "the history of {} began forty years ago",
    "we met two people from {} last summer",
    "{} announced a new product for its customers",
    "the {} group won the match by three points",
    "a photo of {} hangs in the hall",
    "he read a book on {} during the flight",
    "the road from {} to the coast was closed",
    "many visitors came to see {} this year",
    "{} and its partners opened an office abroad",
    "the {} team runs the tests every night",
    "a total {} could be seen from the island",
)
#: Names of licences, and short notices that give nothing else.
TERMS = {
    "MIT": ("MIT",),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0"),
    "GPL-3.0": ("GPL-3.0", "GPLv3"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3"),
    "ISC": ("ISC",),
    "EPL-2.0": ("EPL-2.0", "EPL 2.0"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0"),
}
NOTICES = ("{}", "Distributed under {}.", "Released under the {} terms", "Dedicated to everyone under {}", "SPDX-License-Identifier: {}")
FILLER = (
    "the of and to in that with for over under near report value method result table house water light number system order city music paper "
    "by on is it as at you this not are or an a all can has into any may be from was were which that there when who its if no so such use see"
).split()

COMMON = frozenset(FILLER)
#: Numbers of strange words that are features, and samples that a gram has to stand in.
CROWDS, LEAST_USE = (1, 3, 6), 4


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    features: dict[str, int]
    weights: np.ndarray  # by feature and class, the last class unknown
    bias: np.ndarray
    least: float


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def crowd_of(text: str, features: Collection[str]) -> set[str]:
    """Features for how many different words a model doesn't know."""
    strange = sum(w not in features and w not in COMMON for w in set(words_of(text)))
    return {f"#{n}" for n in CROWDS if strange >= n}


def samples(copies: int = COPIES, seed: int = 3) -> list[tuple[str, str, int]]:
    """(paragraph, family, number of what it was made from), with words dropped and others put around."""
    r = np.random.default_rng(seed)
    filler = lambda n: [FILLER[int(k)] for k in r.integers(0, len(FILLER), n)]
    strange = lambda n: ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(3, 10)))) for _ in range(n)]

    def vary(words: list[str], drop: float = 0.08, most: int = 4) -> str:
        """Words with others around, of which up to ``most`` nobody knows."""
        kept, odd = [w for w in words if r.random() > drop], strange(int(r.integers(0, most + 1)))
        cut = int(r.integers(0, len(odd) + 1))
        return " ".join([*filler(int(r.integers(0, 8))), *odd[:cut], *kept, *odd[cut:], *filler(int(r.integers(0, 8)))])

    templates = [(t, f) for f, ts in TEMPLATES.items() for t in ts]
    out = [(vary(t.split()), f, k) for k, (t, f) in enumerate(templates) for _ in range(copies)]
    # a few words of a licence in any order, or a sentence with licence words or the name of one, state none
    for k, (t, _) in enumerate(templates):
        out += [(" ".join([*r.permutation(t.split())[: int(r.integers(1, 4))].tolist(), *filler(8), *strange(int(r.integers(0, 6)))]), UNKNOWN, k) for _ in range(copies // 2)]
    out += [(vary(t.split()), UNKNOWN, k) for k, t in enumerate(ORDINARY) for _ in range(copies)]
    for k, t in enumerate(MENTIONS):
        out += [(vary(t.format(n).split(), 0.0), UNKNOWN, k) for n in NAMES for _ in range(max(1, copies // 16))]
    out += [(" ".join([*filler(int(r.integers(1, 8))), n, *strange(int(r.integers(2, 9)))]), UNKNOWN, k) for k, n in enumerate(NAMES * 2) for _ in range(copies // 4)]
    out += [(" ".join([*filler(int(r.integers(5, 80))), *strange(int(r.integers(0, 9)))]), UNKNOWN, k) for k in range(20 * copies)]
    for k, (f, t, n) in enumerate((f, t, n) for f, ts in TERMS.items() for t in ts for n in NOTICES):
        out += [(vary(n.format(t).split(), 0.0, 1) if c % 2 else n.format(t), f, k) for c in range(max(1, copies // 4))]
    return out


def train(labelled: list[tuple[str, str, int]], features: int = FEATURES, rounds: int = 500) -> Model:
    """A model from labelled paragraphs; of the unknown, whatever was made from every fifth source is held out for calibration."""
    families = tuple(sorted({f for _, f, _ in labelled} - {UNKNOWN}))
    classes = {f: k for k, f in enumerate((*families, UNKNOWN))}
    sets = [grams_of(t) for t, _, _ in labelled]
    y = np.array([classes[f] for _, f, _ in labelled])
    unknown = y == classes[UNKNOWN]
    held = unknown & (np.array([source for _, _, source in labelled]) % 5 == 4)
    counts = Counter(g for s, h in zip(sets, held, strict=True) if not h for g in s if not COMMON.issuperset(g.split(" ")))
    often = [g for g in counts if counts[g] >= LEAST_USE]
    vocabulary = {g: k for k, g in enumerate(sorted(often, key=lambda g: (-counts[g], g))[: features - len(CROWDS)])}
    vocabulary |= {f"#{n}": len(vocabulary) + k for k, n in enumerate(CROWDS)}
    x = np.zeros((len(y), len(vocabulary)))
    for row, (s, (text, _, _)) in enumerate(zip(sets, labelled, strict=True)):
        x[row, [vocabulary[g] for g in (*s, *crowd_of(text, vocabulary)) if g in vocabulary]] = 1
    seen, target = x[~held], np.eye(len(classes))[y[~held]]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):  # proximal gradient descent
        p = soft(seen @ w + b) - target
        w -= RATE * (seen.T @ p / len(seen))
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSE, 0)
        b -= RATE * p.mean(0)
    p = soft(x[held] @ w + b)
    least = float(np.quantile(p[:, :-1].max(1), 0.99)) if len(p) else 0.5
    names = list(vocabulary)
    # single words stay even without weight: a word is strange only if training hasn't seen it
    used = [k for k in range(len(names)) if (w[k] != 0).any() or " " not in names[k]]
    return Model(families, {names[at]: k for k, at in enumerate(used)}, np.round(w[used], 5), np.round(b, 5), least)


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def constant(values: list, kind: str, mark: str = "|") -> Column:
    """An array that Spark folds to one literal."""
    return F.split(F.lit(mark.join(map(str, values))), "[|]").cast(f"array<{kind}>")


def slot(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % SLOTS).cast("int")


def most_added(model: Model) -> tuple[dict[str, float], float]:
    """By word, the most that its presence can add to any family's lead over unknown, and the sum without which none is sure.

    What a pair of words adds is counted at one of the two, the one that says more by itself.
    """
    leads = model.weights[:, :-1] - model.weights[:, -1:]
    best = dict(zip(model.features, np.maximum(leads.max(1), 0.0).tolist(), strict=True))
    crowd = sum(best.pop(f"#{n}", 0.0) for n in CROWDS)
    most: Counter[str] = Counter()
    for gram, added in best.items():
        most[max(gram.split(" "), key=lambda w: (w not in FILLER, best.get(w, 0.0), w))] += added
    least = max(math.log(model.least / (1 - model.least)), 0.0)  # at least as likely as unknown
    return {w: round(m, 5) for w, m in most.items() if m > 0}, least - float((model.bias[:-1] - model.bias[-1]).max()) - crowd - 1e-3


def most_by_family(model: Model) -> tuple[dict[str, list[float]], list[float]]:
    """What ``most_added`` gives, for each family by itself."""
    leads = np.maximum(model.weights[:, :-1] - model.weights[:, -1:], 0.0)
    best = dict(zip(model.features, leads.max(1).tolist(), strict=True))
    by_word: dict[str, np.ndarray] = {}
    crowd = np.zeros(leads.shape[1])
    for gram, k in model.features.items():
        if gram[0] == "#":
            crowd += leads[k]
        else:
            word = max(gram.split(" "), key=lambda w: (w not in FILLER, best.get(w, 0.0), w))
            by_word[word] = by_word.get(word, 0.0) + leads[k]
    least = max(math.log(model.least / (1 - model.least)), 0.0)
    needed = least - (model.bias[:-1] - model.bias[-1]) - crowd - 1e-3
    return {w: np.round(v, 5).tolist() for w, v in by_word.items() if v.max() > 0}, needed.tolist()


def places(features: dict[str, int]) -> list[Column]:
    """Arrays that hold, by slot, the places of the features there; one array for each feature that shares a slot."""
    held: dict[int, list[int]] = {}
    for gram, k in features.items():
        held.setdefault(zlib.crc32(gram.encode()) % SLOTS, []).append(k)
    return [constant([held[s][j] if len(held.get(s, ())) > j else -1 for s in range(SLOTS)], "int") for j in range(max(map(len, held.values()), default=0))]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+", -1), "")


def worded(text: Column) -> Column:
    """Whether a licence word stands in a text; the pattern is only tried where one of its stems is."""
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(stem)) for stem in STEMS]) & text.rlike(WORDS)


def pairs_of(w: Column) -> Column:
    """Distinct neighbours of an array of words."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression in which a value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def judged(model: Model) -> Callable[[Column], Column]:
    """An array of words to (probability, of the likeliest family; guess; leads: whether it is likelier than unknown)."""
    k = len(model.families) + 1
    names, weights, bias = constant(list(model.features), "string"), constant(np.ravel(model.weights).tolist(), "double"), constant(model.bias.tolist(), "double")
    tables, fillers, families = places(model.features), constant(sorted(COMMON), "string"), constant(list(model.families), "string")

    def place(g: Column) -> Column:
        found = [F.get(t, slot(g)) for t in tables]
        return F.coalesce(*[F.when(F.get(names, a) == g, a) for a in found], F.lit(-1))

    def strange(words: Column) -> Column:
        return F.size(F.filter(F.array_distinct(words), lambda w: (place(w) < 0) & ~F.array_contains(fillers, w)))

    crowds = [(n, model.features[f"#{n}"]) for n in CROWDS if f"#{n}" in model.features]

    def at(words: Column) -> Column:
        known = F.filter(F.transform(F.array_union(words, pairs_of(words)), place), lambda a: a >= 0)
        if not crowds:
            return known
        return F.concat(known, bind(strange(words), lambda n: F.filter(F.array(*[F.when(n >= least, F.lit(a)).otherwise(-1) for least, a in crowds]), lambda a: a >= 0)))

    def logits(places_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.get(bias, c) + F.aggregate(places_, F.lit(0.0), lambda s, a: s + F.get(weights, a * k + c)))

    def odds(of: Column) -> Column:
        return bind(F.array_max(of), lambda top: F.transform(of, lambda x: F.exp(x - top)))

    def verdict(found: Column) -> Column:
        best = F.array_max(F.slice(found, 1, k - 1))
        return F.struct((best / F.aggregate(found, F.lit(0.0), lambda s, x: s + x)).alias("probability"), F.get(families, F.array_position(found, best).cast("int") - 1).alias("guess"), (best >= F.get(found, F.lit(k - 1))).alias("leads"))

    return lambda words: bind(at(words), lambda a: bind(logits(a), lambda x: bind(odds(x), verdict)))


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Per licence paragraph: doc_id, paragraph (its first line, from 0), lines, family, probability, similarity, confirmed."""
    model = model or train(samples())
    most, needed = most_added(model)
    judge = judged(model)

    def sure(verdict: Column) -> Column:
        return (verdict["probability"] >= model.least) & verdict["leads"]

    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a text whose distinct words fall short together holds no unit that doesn't; most texts go here
    telling, each = constant(list(most), "string"), constant(list(most.values()), "double")

    def added(met: Column) -> Column:
        return F.aggregate(met, F.lit(0.0), lambda s, w: s + F.get(each, F.array_position(telling, w).cast("int") - 1))

    docs = docs.withColumn("met", F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+", -1), telling))
    docs = docs.withColumn("may", worded(F.col("text"))).where(F.col("may") | (added(F.col("met")) >= needed))
    docs = docs.select("doc_id", "may", "met", F.split("text", r"\r\n|\n|\r", -1).alias("text_lines"))
    docs = docs.withColumn("words", F.transform("text_lines", split_words)).withColumn("hits", F.transform("words", lambda w: F.array_intersect(w, F.col("met"))))
    by_family, needs = most_by_family(model)
    k = len(needs)
    shares, needs = constant([v for w in most for v in by_family.get(w, [0.0] * k)], "double"), constant(needs, "double")

    def may_be_sure(hits: Column) -> Column:
        """Whether the distinct words of a unit that add anything can be enough for any one family."""
        at = F.transform(hits, lambda w: (F.array_position(telling, w).cast("int") - 1) * k)
        each_family = lambda places_: F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.aggregate(places_, F.lit(0.0), lambda s, p: s + F.get(shares, p + f)) >= F.get(needs, f))
        return (F.size(hits) > 0) & (added(hits) >= needed) & bind(at, each_family)

    unit = lambda at, n, named, w, parts: F.struct(at.alias("paragraph"), n.alias("lines"), named.alias("worded"), w.alias("w"), parts.alias("parts"))
    none = F.array().cast("array<array<string>>")
    numbers = F.sequence(F.lit(0), F.size("text_lines") - 1)
    named = lambda i: F.col("may") & worded(F.get("text_lines", i))
    single = F.filter(F.transform(numbers, lambda i: F.struct(i.alias("at"), named(i).alias("worded"))), lambda x: x["worded"] | may_be_sure(F.get("hits", x["at"])))
    singles = F.transform(single, lambda x: unit(x["at"], F.lit(1), x["worded"], F.get("words", x["at"]), none))
    full = lambda i: F.length(F.btrim(F.get("text_lines", i), F.lit(" \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"))) > 0
    starts = F.filter(numbers, lambda i: full(i) & ((i == 0) | ~full(i - 1)))
    ends = F.filter(numbers, lambda i: full(i) & ((i == F.size("text_lines") - 1) | ~full(i + 1)))
    runs = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: (x["e"] > x["s"]) & may_be_sure(F.array_distinct(F.flatten(F.slice("hits", x["s"] + 1, x["e"] - x["s"] + 1)))))
    wrapped = F.transform(runs, lambda x: bind(F.slice("words", x["s"] + 1, x["e"] - x["s"] + 1), lambda parts: unit(x["s"], F.size(parts), F.lit(False), F.flatten(parts), parts)))
    chosen = docs.select("doc_id", F.explode_outer(F.concat(singles, wrapped)).alias("x")).select("doc_id", "x.*")
    chosen = chosen.withColumn("pairs", pairs_of(F.col("w"))).withColumn("verdict", judge(F.col("w")))

    def likeness(pairs: Column, guess: Column) -> Column:
        """The largest share of a template of the guessed family that stands in a unit."""
        out = F.lit(0.0)
        for family in model.families:
            shares = [F.size(F.array_intersect(pairs, constant(own, "string"))) / F.lit(float(len(own))) for own in template_pairs(family)]
            if shares:
                out = F.when(guess == family, F.greatest(*shares, F.lit(0.0))).otherwise(out)
        return out

    chosen = chosen.withColumn("similarity", likeness(F.col("pairs"), F.col("verdict.guess")))
    across = (F.col("lines") == 1) | ~F.exists("parts", lambda w: sure(judge(w)))  # only asked where the whole is sure
    chosen = chosen.withColumn("sure", F.when(sure(F.col("verdict")), across).otherwise(F.lit(False)))
    row = F.struct("doc_id", "paragraph", "lines", F.when(F.col("sure"), F.col("verdict.guess")).otherwise(UNKNOWN).alias("family"), F.col("verdict.probability").alias("probability"), "similarity", (F.col("sure") & (F.col("similarity") >= ALIKE)).alias("confirmed"))
    # through explode, as a filter on the score would be pushed down with a copy of every expression below it
    return chosen.select(F.explode_outer(F.array(F.when(F.col("worded") | F.col("sure"), row))).alias("row")).where(F.col("row").isNotNull()).select("row.*")


def template_pairs(family: str) -> list[list[str]]:
    """The distinct 2-grams of each template of a family."""
    split = [words_of(t) for t in TEMPLATES.get(family, ())]
    return [sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) for w in split]
