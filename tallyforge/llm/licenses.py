"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of a text is a possible header, and so is every run of as many words as
some template has, across line feeds and inside longer lines.  A segment (line or
run) is a sparse vector of word counts times inverse document frequency; its licence
is that of the template with the largest cosine, if that reaches ``threshold``.  Document frequencies of the templates' words are
counted over all documents; a word of no template weighs like one that no document
has.  Vectors are made only of segments that can reach the threshold: the words
outside the templates bound the norm from below, so that test loses nothing.

Whole texts are compared with complete licence texts (``licence_texts``), by
weights of their own: a word that occurs c times counts 1 + ln c, since the common
words of a long licence would outweigh all others, and ``FILE_THRESHOLD`` must be reached.

A licence file gives its licence to its directory.  It is a text that matches a
complete licence text, or one whose name says so (LICENSE, COPYING ...) and that has
a header.  A source file that has a header, however short it is, is no licence file.
An SPDX-License-Identifier tag is a header that needs no comparing: it names the
licence itself, with score 1.  A file without a licence of its own
inherits from the nearest ancestor directory that has one: the distinct directories
are joined with licensed ones by path, level by level of their ancestors.

Defined results
* null text: no licence of its own, but it may inherit; the same for empty text
* several licences in a text: the first SPDX tag (of an expression the first licence, without -only or -or-later), else the line or run with the largest cosine, then the alphabetically first licence
* a sentence that denies a licence ("not licensed under ...") counts like the header that it repeats
* several licence files in a directory: the largest cosine, then the alphabetically first licence
* null path, or a path without directory: no ancestors, so nothing to inherit
* repeated rows get equal results; an empty table gives an empty result
* very long texts are scanned whole; extra columns are ignored
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import U64, Words, slices, utf8
from .shared import arrow_map, join_small, written

THRESHOLD, FILE_THRESHOLD = 0.7, 0.85
#: The tag's licence; a full stop behind it is no part of it.
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9]+(?:[.-]+[A-Za-z0-9]+)*)"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
#: (licence, wording); a licence may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def tokens(text: str) -> list[bytes]:
    """Words as the scan sees them: runs of letters, digits and non-ASCII bytes, ASCII in lower case."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode("utf-8", "surrogatepass").translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


@functools.cache
def full_texts() -> list[tuple[str, str]]:
    """(licence, complete text without a copyright line) from the files beside this module."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.append((name.removesuffix(".txt"), f.read()))
    return out


def vocabulary(templates: list[tuple[str, str]]) -> list[bytes]:
    return sorted({w for _, wording in templates for w in tokens(wording)})


def _hashes(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the vocabulary and the number of the word that each belongs to."""
    data = np.frombuffer(b" ".join(vocab), np.uint8)
    h = Words(data, np.array([0, len(data)])).hashes()
    order = np.argsort(h)
    return h[order], order


def _numbers(words: Words, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each word its number in the vocabulary, or -1."""
    h = words.hashes()
    at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
    return np.where(known[0][at] == h, known[1][at], -1)


def document_frequencies(docs: DataFrame, vocab: list[bytes]) -> tuple[int, np.ndarray]:
    """(documents with text, how many of them have each word), over the whole table; the answer is as small as the templates."""
    known, size = _hashes(vocab), len(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(*utf8(part.column(0)))
                number = _numbers(words, known)
                some = number >= 0
                df += np.bincount(np.unique(words.doc[some] * size + number[some]) % size, minlength=size)
                total += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append([total], df))], names=["word", "n"])

    counts = arrow_map(docs.select("text").where("text is not null"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r["word"]: r["n"] for r in counts}
    return by_word.get(-1, 0), np.array([by_word.get(i, 0) for i in range(size)])


class Scanner:
    """Template vectors with the corpus's weights; travels with the tasks."""

    def __init__(self, templates: list[tuple[str, str]], documents: int, frequencies: np.ndarray, threshold: float, damped: bool = False):
        self.damped = damped
        self.vocab = vocabulary(templates)
        self.known, self.threshold = _hashes(self.vocab), threshold
        self.idf = np.log((1 + documents) / (1 + frequencies)) + 1
        self.outside = float(np.log(1 + documents) + 1)
        number = {w: i for i, w in enumerate(self.vocab)}
        rows = np.zeros((len(templates), len(self.vocab)))
        for i, (_, wording) in enumerate(templates):
            for w, n in Counter(tokens(wording)).items():
                rows[i, number[w]] = self.times(n) * self.idf[number[w]]
        self.rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        self.names = [name for name, _ in templates]
        self.order = np.array([sorted(set(self.names)).index(x) for x in self.names])
        self.lengths = sorted({len(tokens(wording)) for _, wording in templates})

    def times(self, n):
        """What n occurrences of a word count."""
        return 1 + np.log(n) if self.damped else n

    def best(self, words: Words, number: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """(template or -1, cosine) of each segment; ``segment`` numbers the one that each word stands in."""
        size = len(self.vocab)
        template, cosine = np.full(segments, -1), np.zeros(segments)
        some = number >= 0
        key, count = np.unique(segment[some] * size + number[some], return_counts=True)
        if not len(key):
            return template, cosine
        seg, word = key // size, key % size
        weight = self.times(count) * self.idf[word]
        outside = np.bincount(segment[~some], minlength=segments)
        norm = np.bincount(seg, weight**2, segments) + (outside > 0 if self.damped else outside) * self.outside**2
        top = np.zeros(segments)
        for row in self.rows:
            np.maximum(top, np.bincount(seg, weight * row[word], segments), out=top)
        # Summing in another order may change the last digits, so the test leaves some room.
        hopeful = np.flatnonzero(top >= (self.threshold - 1e-9) * np.sqrt(norm))
        hopeful = hopeful[norm[hopeful] > 0]
        begin, end = np.searchsorted(segment, hopeful), np.searchsorted(segment, hopeful, "right")
        for s, a, b in zip(hopeful.tolist(), begin.tolist(), end.tolist()):
            counts = Counter(words.data[x:y].tobytes().lower() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist()))
            vector = np.zeros(size)
            rest = 0.0
            at = dict(zip((words.data[x:y].tobytes().lower() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist())), number[a:b].tolist()))
            for w, n in counts.items():
                if at[w] >= 0:
                    vector[at[w]] = self.times(n) * self.idf[at[w]]
                else:
                    rest += (self.times(n) * self.outside) ** 2
            scores = np.round(self.rows @ vector / np.sqrt(vector @ vector + rest), 9)
            if scores.max() >= self.threshold:
                ties = np.flatnonzero(scores == scores.max())
                template[s] = ties[self.order[ties].argmin()]
                cosine[s] = scores.max()
        return template, cosine

    def windows(self, words: Words, number: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(template or -1, cosine) of each text's best run of as many words as a template has; every start is tried."""
        template, cosine = np.full(docs, -1), np.zeros(docs)
        some = number >= 0
        weight = np.where(some, self.idf[number], self.outside)
        # A word adds at least its weight's square to the norm's, and at most its largest share of any template to the product.
        reach = np.concatenate([[0], np.cumsum(np.where(some, weight * self.rows.max(axis=0)[number], 0))])
        norm = np.concatenate([[0], np.cumsum(weight**2)])
        h = words.hashes()
        for length in self.lengths:
            if length > len(number):
                break
            start = np.arange(len(number) - length + 1)
            likely = reach[length:] - reach[:-length] >= (self.threshold - 1e-9) * np.sqrt(norm[length:] - norm[:-length]) - 1e-9
            start = start[likely & (words.doc[start] == words.doc[start + length - 1])]
            for chunk in np.array_split(start, len(start) // 2000 + 1):
                at = chunk[:, None] + np.arange(length)
                times = (h[at][:, :, None] == h[at][:, None, :]).sum(axis=2)
                size = np.sqrt((weight[at] ** 2 * times).sum(axis=1))
                product = np.zeros((len(chunk), len(self.rows)))
                for j in range(length):
                    column = at[:, j]
                    product += np.where(some[column], weight[column], 0)[:, None] * self.rows[:, number[column]].T
                scores = np.round(product / size[:, None], 9)
                top = scores.max(axis=1, initial=0)
                for k in np.flatnonzero(top >= self.threshold):
                    ties = np.flatnonzero(scores[k] == top[k])
                    found, d = ties[self.order[ties].argmin()], words.doc[chunk[k]]
                    if template[d] < 0 or (top[k], -self.order[found]) > (cosine[d], -self.order[template[d]]):
                        template[d], cosine[d] = found, top[k]
        return template, cosine


def _matched(scanner: Scanner, files: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                data, at = utf8(part.column(1))
                words = Words(data, at)
                number = _numbers(words, scanner.known)
                # Lines: a new one after each line feed and at each text's beginning.
                breaks = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
                line = np.searchsorted(breaks, words.start, "right") - 1
                doc_of = np.searchsorted(at, breaks, "right") - 1
                template, cosine = scanner.best(words, number, line, len(breaks))
                whole, whole_cosine = files.best(words, _numbers(words, files.known), words.doc, n)
                best, score = scanner.windows(words, number, n)
                for s in np.flatnonzero(template >= 0):
                    d = min(int(doc_of[s]), n - 1)
                    new = (cosine[s], -scanner.order[template[s]])
                    if best[d] < 0 or new > (score[d], -scanner.order[best[d]]):
                        best[d], score[d] = template[s], cosine[s]
                name = lambda x, t: pa.array([x.names[i] if i >= 0 else None for i in t], pa.string())
                columns = [part.column(0), part.column(2), part.column(3), name(scanner, best), pa.array(score), name(files, whole), pa.array(whole_cosine)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "path", "tag", "line", "line_score", "whole", "whole_score"])

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, how, score, license_dir) of every row: how is file, header, inherited or none; license_dir is the directory inherited from."""
    path = F.col("path") if path is None else path
    text = F.col(f"`{text_col}`")
    # Null where there is no tag.
    tag = F.regexp_replace(F.nullif(F.regexp_extract(text, SPDX, 1), F.lit("")), "-(only|or-later)$", "")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), path.cast("string").alias("path"), tag.alias("tag"))
    vocab, texts = vocabulary([*templates, *full_texts()]), full_texts()
    total, frequencies = document_frequencies(docs, vocab)
    counted = dict(zip(vocab, frequencies.tolist()))
    of = lambda x: np.array([counted[w] for w in vocabulary(x)])
    scanner, files = Scanner(templates, total, of(templates), threshold), Scanner(texts, total, of(texts), FILE_THRESHOLD, damped=True)
    id_type = docs.schema["id"].dataType.simpleString()
    found = arrow_map(docs, _matched(scanner, files), f"id {id_type}, path string, tag string, line string, line_score double, whole string, whole_score double")
    found = found.withColumn("line", F.coalesce("tag", "line")).withColumn("line_score", F.when(F.col("tag").isNotNull(), 1.0).otherwise(F.col("line_score")))
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    is_file = F.col("whole").isNotNull() | (named & F.col("line").isNotNull())
    own = F.coalesce("whole", "line")
    score = F.when(F.col("whole").isNotNull(), F.col("whole_score")).otherwise(F.col("line_score"))
    place = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", ""))
    own_how = F.when(is_file, "file").when(F.col("line").isNotNull(), "header")
    narrow = written(found.select("id", place.alias("dir"), own.alias("own"), score.alias("score"), own_how.alias("own_how")), "licenses")

    licensed = narrow.where("own_how = 'file' and dir is not null").groupBy("dir").agg(F.min(F.struct(-F.col("score"), F.col("own"))).alias("b")).select(F.col("dir").alias("up"), F.col("b.own").alias("inherited"), (-F.col("b").getField("col1")).alias("up_score"))
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("up")))
    above = narrow.where("own is null and dir is not null").select("dir").distinct().select("dir", F.explode(ups).alias("a")).select("dir", "a.depth", "a.up")
    nearest = above.join(licensed, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "inherited", "up_score")).alias("n")).select("dir", F.col("n.up").alias("license_dir"), "n.inherited", "n.up_score")
    nearest = written(nearest, "license-dirs")
    # A row for each directory below a licence file: counted before it is decided how to join.
    out = join_small(narrow, nearest, ["dir"], "left", nearest.count())
    inherits = F.col("own").isNull() & F.col("inherited").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("own", "inherited").alias("license"),
        F.coalesce("own_how", F.when(inherits, "inherited"), F.lit("none")).alias("how"),
        F.round(F.when(F.col("own").isNotNull(), F.col("score")).when(inherits, F.col("up_score")), 4).alias("score"),
        F.when(inherits, F.col("license_dir")).alias("license_dir"),
    )
