"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line with the words after it, as many as the longest template has and of at most the next ``LINES`` lines,
so a notice is found whether it stands in one line or is wrapped. A template is found in a block if at least ``threshold``
of its distinct words stand in the block (containment |T & B| / |T|). The join is exact:

* tokens have one global order, rarest first by the number of lines they stand in over the whole table; tokens of no
  template can never match and come last, so a block is kept as its template tokens alone;
* prefix filter: a block with overlap o or more holds one of the |T| - o + 1 rarest tokens of T, so only those are
  looked up;
* length filter: the block has at least o template tokens;
* positional filter: the first common token, at place i of T and j of the block, leaves at most
  1 + min(|T| - i - 1, |B| - j - 1) common tokens;
* what is left is counted exactly.

The template side is a set of constants, whatever the input, so it is what is broadcast; blocks are exploded only for
texts that hold a prefix token. DataFrame functions alone touch texts.

Defined results: a null text counts as empty and has no words; a text without matches has null places, empty labels and
score 0. Equal rows get equal results. Null doc_ids are kept. An empty table gives no rows. Other columns of the input
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm._common import cut, text_of

#: A word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Lines over which a block may run on.
LINES = 4

# Phrases with their labels, and wordings of public licenses with theirs.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def lowered(text: Column) -> Column:
    """Lower case for ASCII matching: the one other character whose lower case is an ASCII letter is set aside."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ÿ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def all_words(wording: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in wording.lower()).split()


def template_words(wording: str) -> list[str]:
    """Distinct words of an ASCII wording, in order."""
    return list(dict.fromkeys(all_words(wording)))


def reach(templates=TEMPLATES) -> int:
    """Words after a line that belong to its block."""
    return max(len(all_words(wording)) for _, wording in templates)


def line_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many lines of the table each token of the vocabulary stands: one row per token comes back."""
    lines = docs.select(F.explode(F.split(lowered(text_of()), "\n")).alias("line"))
    seen = lines.select(F.explode(F.array_distinct(tokens(F.col("line")))).alias("token")).where(F.col("token").isin(vocabulary))
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Templates with their tokens in the global order of a table, and the prefix entries that blocks are looked up in."""

    def __init__(self, docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD):
        sets = [(label, template_words(wording)) for label, wording in templates]
        vocabulary = sorted({w for _, words in sets for w in words})
        counts = line_counts(docs, vocabulary)
        self.order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.entries = []  # (token, label, place in the template, words of the template, least overlap)
        for label, words in sets:
            words = sorted(words, key=rank.__getitem__)
            least = math.ceil(threshold * len(words) - 1e-9)
            self.entries += [(w, label, i, words, least) for i, w in enumerate(words[: len(words) - least + 1])]
        self.prefix = sorted({e[0] for e in self.entries})
        self.least = min(e[4] for e in self.entries)
        self.reach = reach(templates)

    def lines(self, text: Column, words: Column) -> Column:
        """The words of each line of a lowered text, if it holds a prefix token at all; else null."""
        return F.when(F.arrays_overlap(words, F.lit(self.prefix)), F.transform(F.split(text, "\n"), tokens))

    def candidates(self, lines: str) -> Column:
        """(place, block) of the lines whose block holds a prefix token; null if lines is."""
        placed = F.transform(lines, lambda x, i: F.struct(i.alias("place"), F.concat(x, F.slice(F.flatten(F.slice(lines, i + 2, F.lit(LINES))), 1, self.reach)).alias("block")))
        return F.filter(placed, lambda x: F.arrays_overlap(x["block"], F.lit(self.prefix)))

    def table(self, spark) -> DataFrame:
        rows = [F.struct(F.lit(w).alias("token"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(words).alias("words"), F.lit(least).alias("least")) for w, label, i, words, least in self.entries]
        return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")

    def join(self, blocks: DataFrame, *keys: str) -> DataFrame:
        """keys, label and containment of every block (column block: its words) that meets the threshold."""
        # The global order restricted to template tokens is that of the constant array.
        held = blocks.select(*keys, F.array_intersect(F.lit(self.order), F.col("block")).alias("held")).where(F.size("held") >= self.least)
        found = held.select("*", F.posexplode("held").alias("at", "token")).where(F.col("token").isin(self.prefix))
        joined = found.join(F.broadcast(self.table(blocks.sparkSession)), "token")
        left = F.least(F.size("words") - F.col("i"), F.size("held") - F.col("at"))
        common = F.size(F.array_intersect("words", "held"))
        exact = joined.where((F.size("held") >= F.col("least")) & (left >= F.col("least"))).select(*keys, "label", "least", common.alias("common"), (common / F.size("words")).alias("containment"))
        return exact.where("common >= least").select(*keys, "label", "containment").distinct()


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, version (hash of the text), place (of the line), label and containment of every block that meets the threshold."""
    index = Index(docs, templates, threshold)
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), lowered(text_of()).alias("text"))
    lined = texts.select("doc_id", "version", index.lines(F.col("text"), tokens(F.col("text"))).alias("lines"))
    blocks = lined.select("doc_id", "version", F.explode(index.candidates("lines")).alias("b")).select("doc_id", "version", "b.*")
    return index.join(blocks, "doc_id", "version", "place")


def phrase_starts(parts: list[str]) -> Column:
    """Places in the column words where the parts stand one after the other, from the places of possible last words in the column ends."""
    before = len(parts) - 1

    def stands(end: Column) -> Column:
        held = end >= before
        for k, part in enumerate(parts):
            held = held & F.coalesce(F.get("words", end - (before - k)) == part, F.lit(False))
        return held

    return F.transform(F.filter("ends", stands), lambda end: end - before)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest containment of a match) per document."""
    index = Index(docs, templates, threshold)
    base = docs.select("doc_id", F.xxhash64(text_of()).alias("version"), lowered(text_of()).alias("text")).select("doc_id", "version", "text", tokens(F.col("text")).alias("words"))
    # A phrase is known by the place of its last word, so only those places are looked at.
    last_words = sorted({p.split()[-1] for p, _ in PHRASES})
    spans = base.withColumn("ends", F.when(F.arrays_overlap("words", F.lit(last_words)), F.filter(F.transform("words", lambda x, i: F.when(x.isin(last_words), i)), lambda i: i.isNotNull())))
    for n, (phrase, _) in enumerate(PHRASES):
        starts = phrase_starts(phrase.split())
        spans = spans.withColumn(f"starts{n}", F.coalesce(starts, F.array().cast("array<int>")))
    names = [f"starts{n}" for n in range(len(PHRASES))]
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(names, PHRASES, strict=True)]), lambda x: x.isNotNull())))
    places = F.concat(*names)
    # Texts are read once more than for the counts; what is kept of each is a few numbers and its candidate lines.
    spans = spans.withColumn("lines", index.lines(F.col("text"), F.col("words")))
    own = cut(spans.select(
        "doc_id", "version", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), labels.alias("base"), index.candidates("lines").alias("lines"),
    ))
    blocks = own.select("doc_id", "version", F.explode("lines").alias("b")).select("doc_id", "version", "b.block")
    by_doc = index.join(blocks, "doc_id", "version").groupBy("doc_id", "version").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    by_doc = by_doc.select(F.col("doc_id").alias("m_doc"), F.col("version").alias("m_version"), "found", "score")
    both = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("version") == F.col("m_version")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))

