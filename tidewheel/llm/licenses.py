"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

All of it is DataFrame functions. Line breaks, indentation and comment marks are no words, so
a notice is one run of words however it is wrapped. A block is a run of 2 * span words, one
every span words, where span is the power of two (16 at least) that a template fits into:
every run of span words lies in one block, and words that only happen to stand in one long
text lie in none. A block matches a template T when it holds at least ``threshold`` of T's
distinct words, and all those that set T apart from other templates.

The join orders words by how many documents of the whole corpus hold them, rarest first. With
``need`` words of T required, a match has one of T's first |T| - need + 1 words among the
block's first |B| - need + 1 words (prefix filter; B: the block's template words), at places
that leave enough words for ``need`` (positional filter), and |B| >= need (length filter).
What passes is counted in full. Blocks are made of documents that hold enough words of some
template as a whole. Templates are a fixed parameter, so their side is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licenses, their labels, and the words that a match must have.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("mit-notice", "Released under the MIT License", "mit"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]
THRESHOLD, LEAST_SPAN = 0.8, 16
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_list(text: str) -> list[str]:
    return re.sub(NOT_WORD, " ", text).lower().split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[str, ...]
    need: int
    span: int


def made(entry: tuple[str, ...], threshold: float = THRESHOLD) -> Template:
    """From a label, a text and, if there are any, the words that a match must have."""
    label, text, must = (*entry, "")[:3]
    sequence = word_list(text)
    words = tuple(sorted(set(sequence)))
    span = max(LEAST_SPAN, 1 << max(0, len(sequence) - 1).bit_length())
    return Template(label, words, tuple(sorted(set(word_list(must)) & set(words))), need_of(words, threshold), span)


def need_of(words: Sequence[str], threshold: float) -> int:
    return math.ceil(round(threshold * len(words), 9))


def normal(text: Column) -> Column:
    """Words with single spaces between, A-Z lower-cased. The Kelvin sign, whose lower case is ASCII, is kept apart."""
    return F.lower(F.replace(F.trim(F.regexp_replace(text, NOT_WORD, " ")), F.lit("K"), F.lit("ĸ")))


def places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number, first and last start (in words) of a phrase in text with two spaces between words and one around."""
    wanted = " " + phrase.replace(" ", "  ") + " "
    words = lambda s: F.size(F.split(F.trim(s), "  "))
    count = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)).cast("long")
    total = words(spaced)
    first = F.when(F.instr(spaced, wanted) == 1, 0).otherwise(words(F.substr(spaced, F.lit(1), F.instr(spaced, wanted))))
    after = F.instr(F.reverse(spaced), wanted[::-1])
    last = total - phrase.count(" ") - 1 - F.when(after == 1, 0).otherwise(words(F.reverse(F.substr(F.reverse(spaced), F.lit(1), after))))
    found = F.contains(spaced, F.lit(wanted))
    return F.when(found, count).otherwise(F.lit(0).cast("long")), F.when(found, first.cast("long")), F.when(found, last.cast("long"))


def listed(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def cut_into_blocks(templates: list[Template], span: int, ranks: Column, nothing: Column) -> Column:
    """Blocks (span, ranks of their template words in order) that hold enough words for some template of this span.

    There are none of documents that do not hold enough words (held) for any of them as a whole.
    """
    words = listed(sorted({w for t in templates for w in t.words}))
    least = min(t.need for t in templates)
    possible = [reduce(lambda a, b: a & b, [F.size(F.array_intersect("held", listed(t.words))) >= t.need, *(F.array_contains("held", w) for w in t.must)]) for t in templates]
    starts = F.sequence(F.lit(0), F.greatest(F.size("text_words") - 1, F.lit(0)), F.lit(span))
    sets = F.transform(starts, lambda at: F.array_intersect(F.slice("text_words", at + 1, F.lit(2 * span)), words))
    sets = F.filter(sets, lambda block: F.size(block) >= least)
    blocks = F.transform(sets, lambda block: F.struct(F.lit(span).alias("span"), F.array_sort(F.transform(block, lambda w: F.element_at(ranks, w))).alias("words")))
    return F.when(reduce(lambda a, b: a | b, possible), blocks).otherwise(nothing)


def scan(documents: DataFrame, templates: Sequence[tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``documents``.

    score: 1 with a phrase, else the largest containment of a match, else 0. A null or empty
    text has no words, labels '' and score 0. Repeated rows give repeated rows; a null doc_id
    is carried. An empty table gives no row. Columns other than doc_id and text are not read.
    """
    phrases = PHRASES if phrases is None else phrases
    chosen = [t for t in (made(entry, threshold) for entry in (TEMPLATES if templates is None else templates)) if t.words]
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for t in chosen for w in t.words})
    norm = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", normal(F.col("text")).alias("norm"))

    held = F.array_intersect(F.split("norm", " "), listed(vocabulary))
    counts = {r["w"]: r["n"] for r in norm.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row for each template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ranks = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))]) if order else F.expr("cast(map() as map<string,int>)")
    index = []
    for i, t in enumerate(chosen):
        in_order = sorted(t.words, key=order.__getitem__)
        index += [(order[w], at, i, t.label, len(t.words), t.need, t.span, [order[x] for x in in_order], [order[x] for x in t.must]) for at, w in enumerate(in_order[: len(t.words) - t.need + 1])]
    prefixes = spark.createDataFrame(index, "rank int, t_at int, template int, label string, t_size int, need int, t_span int, t_ranks array<int>, must array<int>")

    wide = norm.withColumn("spaced", F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" ")))
    found = [places(F.col("spaced"), p) for p in phrases]
    several = lambda f, columns: columns[0] if len(columns) == 1 else f(*columns)
    labelled = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(found, phrases.values(), strict=True)]))
    per_row = wide.select(
        "row",
        "doc_id",
        F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        sum((n for n, _, _ in found), F.lit(0).cast("long")).alias("n_base"),
        several(F.least, [a for _, a, _ in found]).alias("first_word"),
        several(F.greatest, [b for _, _, b in found]).alias("last_word"),
        F.array_sort(F.array_distinct(labelled)).alias("base"),
        F.split("norm", " ").alias("text_words"),
        held.alias("held"),
    )
    keep = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]

    nothing = F.array().cast("array<struct<span:int,words:array<int>>>")
    spans = sorted({t.span for t in chosen})
    cut = F.concat(nothing, *[cut_into_blocks([t for t in chosen if t.span == span], span, ranks, nothing) for span in spans])
    blocks = per_row.select(*keep, F.explode_outer(cut).alias("block")).select(*keep, F.col("block.span").alias("span"), F.col("block.words").alias("words"))
    least = min((t.need for t in chosen), default=1)
    tokens = blocks.withColumn("size", F.size("words")).select(*keep, "span", "words", "size", F.posexplode_outer(F.when(F.col("size") >= least, F.slice("words", F.lit(1), F.greatest(F.col("size") - (least - 1), F.lit(0)))))).withColumnsRenamed({"pos": "b_at", "col": "rank"})
    filters = (tokens["rank"] == prefixes["rank"]) & (F.col("span") == F.col("t_span")) & (F.col("size") >= F.col("need")) & (F.col("size") - F.col("b_at") >= F.col("need") - F.col("t_at")) & (F.col("b_at") <= F.col("size") - F.col("need"))
    matched = tokens.join(F.broadcast(prefixes), filters, "left")
    whole = F.col("template").isNotNull() & (F.size(F.array_except("must", "words")) == 0)
    judged = matched.select(*keep, "label", "need", "t_size", F.when(whole, F.size(F.array_intersect("words", "t_ranks"))).alias("both"))
    judged = judged.select(*keep, F.when(F.col("both") >= F.col("need"), F.col("label")).alias("label"), F.when(F.col("both") >= F.col("need"), F.col("both") / F.col("t_size")).alias("share"))
    rows = judged.groupBy("row").agg(*[F.first(k).alias(k) for k in keep[1:]], F.collect_set("label").alias("added"), F.max("share").alias("share"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "added")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
