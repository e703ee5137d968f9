"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words. A block is a run of consecutive words of a text, across line ends, half as long again
as the template at most; the join finds every block that contains at least `threshold` percent of the words of some
template. Of blocks of one template that overlap the best is reported: no two reported ones overlap, and every other
overlaps a reported one. A second verdict, `named`, tells whether the block has the words that tell the template from
others (a version, a name), which the template lists; such blocks come before others. Words are ordered by their frequency in the whole corpus, rare ones first. A block that misses at most m of a template's
words has one of its m + 1 rarest (prefix filter), the text has enough words of the template at all (length filter),
and so it has from the place of the first shared word on (positional filter). What passes is verified on every block,
with a window that slides over the places of the template's words.

Besides, phrases are looked up as consecutive words of the whole text.

Defined cases: a null text is an empty one and has no labels; of equally good blocks that overlap the first is
reported; a text that is shorter than a block is a block; repeated rows are scanned each; ids may be null or repeated;
no templates, or an empty table, give an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The wording of common public licenses and notices, their labels, and the words that a block must have.
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "granted sublicense"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu 2"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu 3"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", "gnu 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "affero 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions disclaimer"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla 2"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unencumbered"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "alter freely"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "waiving"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons sharealike"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons noncommercial"),
]
#: Templates that are scanned for together; more are scanned for in parts, one after the other.
PART_TEMPLATES = 500

# Bytes of a lower-cased text that belong to no word become blanks.
_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    return (text or "").encode().lower().translate(_BLANKS)


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of the corpus each word of the vocabulary stands; the vocabulary bounds the result."""

    def partial(batches):
        counts = dict.fromkeys(vocabulary, 0)
        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(normal(text).split()):
                    counts[word] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in counted.collect()}


def block_words(n: int) -> int:
    """The words of a block for a template of n words, repeated ones included."""
    return n + n // 2


class Templates:
    """The templates' words in global order, and an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str, str]], threshold: int):
        self.labels, self.sets, self.must, self.block = [], [], [], []
        for label, text, must in templates:
            parts = normal(text).split()
            if parts:
                self.labels.append(label)
                self.sets.append(frozenset(parts))
                self.must.append(frozenset(normal(must).split()))
                self.block.append(block_words(len(parts)))
        self.vocabulary = frozenset().union(*self.sets)
        self.threshold, self.prefix = threshold, {}
        self.needed = [-(-threshold * len(words) // 100) for words in self.sets]

    def order(self, frequency: dict[bytes, int]) -> Templates:
        """Rare words first; the index has each template under the words of its prefix, with the words' places."""
        for t, words in enumerate(self.sets):
            ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            for place, word in enumerate(ordered[: len(words) - self.needed[t] + 1]):
                self.prefix.setdefault(word, []).append((t, place))
        return self

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        """(template, first word of the block, words of the template in it, named) of every block that is reported."""
        have = self.vocabulary.intersection(words)
        tried: dict[int, int] = {}
        for word in have & self.prefix.keys():
            for t, place in self.prefix[word]:
                tried[t] = min(place, tried.get(t, place))
        found = []
        places: dict[bytes, list[int]] = {}
        for t, place in sorted(tried.items()):
            own, needed = self.sets[t], self.needed[t]
            # Length; then position: the words before the first shared one are missing.
            if len(own & have) < needed or len(own) - place < needed:
                continue
            if not places:
                for i, w in enumerate(words):
                    if w in have:
                        places.setdefault(w, []).append(i)
            found += [(t, *block) for block in self._blocks(t, sorted((i, w) for w in own & have for i in places[w]))]
        return found

    def _blocks(self, t: int, places: list[tuple[int, bytes]]) -> list[tuple[int, int, bool]]:
        """The reported blocks in order; a block may as well begin with a word of the template."""
        inside: Counter = Counter()
        must, size, end = self.must[t], self.block[t], 0
        good = []
        for start, word in places:
            while end < len(places) and places[end][0] < start + size:
                inside[places[end][1]] += 1
                end += 1
            if len(inside) >= self.needed[t]:
                good.append((not must <= inside.keys(), -len(inside), start))
            inside[word] -= 1
            if not inside[word]:
                del inside[word]
        taken: list[tuple[int, int, bool]] = []
        for other, n, start in sorted(good):
            at = bisect_left(taken, (start,))
            if (at == 0 or taken[at - 1][0] + size <= start) and (at == len(taken) or start + size <= taken[at][0]):
                taken.insert(at, (start, -n, not other))
        return taken


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: int = 80) -> DataFrame:
    """id_col, n_words, phrase_places (array<struct<label, word>>), blocks (array<struct<word, label, containment, named>>)."""
    parts = []
    for at in range(0, max(len(templates), 1), PART_TEMPLATES):
        index = Templates(templates[at : at + PART_TEMPLATES], threshold)
        parts.append(index.order(word_frequency(docs, index.vocabulary, text_col)))
    wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("named", pa.bool_())]))

    def run(batches):
        parts = shared.value
        for batch in common.slices(batches):
            counts, places, blocks = [], [], []
            for text in batch.column(1).to_pylist():
                words = normal(text).split()
                counts.append(len(words))
                joined = b" " + b" ".join(words) + b" "
                found = []
                for phrase, label in wanted:
                    at, last, word = joined.find(phrase), 0, 0
                    while at >= 0:
                        word += joined.count(b" ", last, at)
                        last = at
                        found.append({"label": label, "word": word})
                        at = joined.find(phrase, at + 1)
                places.append(found)
                blocks.append([{"word": w, "label": index.labels[t], "containment": n / len(index.sets[t]), "named": named} for index in parts for t, w, n, named in index.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(blocks, block_type)], names=["id", "n_words", "phrase_places", "blocks"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, phrase_places array<struct<label string, word long>>, blocks array<struct<word long, label string, containment double, named boolean>>"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A label takes its words: blocks that are not named belong to a license of like wording.
    found = scan(common.table(spark, sf_dir, "documents")).withColumn("blocks", F.filter("blocks", lambda b: b.named))
    base = F.array_sort(F.array_distinct("phrase_places.label"))
    every = F.array_sort(F.array_union("phrase_places.label", "blocks.label"))
    score = F.when(F.size("phrase_places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_places").cast("long").alias("n_base"),
        F.array_min("phrase_places.word").alias("first_word"),
        F.array_max("phrase_places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )
