"""License scans by diagonal voting.

All rolling word 2-gram hashes of the texts are joined to the positions of the same
hashes in license templates. Hits are aggregated by template and diagonal (place in the
text less place in the template); neighbouring diagonals, as a left-out or added word
makes them, are merged, and a span is verified by the share of the template that votes
for it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, groups, hash_spans, light_batches, mix64, pick, table, utf8_view, word_spans

#: The base phrases, found by exact places.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Sentences of public licenses and notices.
TEMPLATES = (
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by", "creative commons attribution license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's words that an aligned span keeps; largest step between merged diagonals; largest gap in words.
VERIFIED, DIAGONAL_STEP, GAP = 0.8, 2, 8
#: Word pairs in a row of hashes that goes to the join; longer texts take more rows.
_CHUNK = 4096
_MARK = 0x5EED5EED5EED5EED  # the mark that keeps one row of each document in the join
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = ascii_lower()


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of each word with the next, as signed 64-bit numbers; one fewer than words."""
    return mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[1:])).view(np.int64)


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of lower-cased bytes."""
    starts, ends = word_spans(data, bounds, _WORD)
    return starts, hash_spans(data, starts, ends)


def template_rows(base=BASE, templates=TEMPLATES) -> list[tuple]:
    """(pair hash, template, place, its vote as a bit, base, label, words, all votes)."""
    rows = [(_MARK, -1, -1, 0, False, "", 0, 0)]
    for i, (label, phrase) in enumerate([*base, *templates]):
        data = np.frombuffer(phrase.encode(), np.uint8)
        words = phrase.split(" ")
        _, hashes = hash_words(data, np.array([0, len(data)]))
        if not 2 <= len(words) <= 60:
            raise ValueError(f"a template takes 2 to 60 words: {phrase!r}")
        full = (1 << (len(words) - 1)) - 1
        rows += [(int(h), i, k, 1 << k, i < len(base), label, len(words), full) for k, h in enumerate(pair_hashes(hashes))]
    return rows


def align(hits: list[tuple[int, int]], words: int) -> tuple[int, int, int]:
    """(errors, first word, last word) of the best in-order chain of hits (place in the text, place in the template).

    A hit says that two words in a row are the template's. Between two hits of a chain the larger number of words
    between them, in the text or in the template, counts as errors, and so do the template's words before the first and after the last hit."""
    hits = sorted(set(hits))
    best: list[tuple[int, int]] = []  # (errors, first place) of the best chain that ends in each hit
    found = (words, 0, 0)
    for at, place in hits:
        own = (place, at)
        for k in range(len(best) - 1, -1, -1):
            was, had = hits[k]
            if at - was > words + GAP:
                break
            if was < at and had < place:
                gap, left = at - was - 2, place - had - 2
                errors = best[k][0] + (max(gap, left) if gap >= 0 and left >= 0 else abs(gap - left))
                own = min(own, (errors, best[k][1]))
        best.append(own)
        found = min(found, (own[0] + words - 2 - place, own[1], at + 1))
    return found


def _verify(spans: DataFrame, kind: str) -> DataFrame:
    """spans with share, and lo and hi of the aligned words; spans with all votes pass as they are."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            rows = batch.to_pydict()
            lo, hi, share = [], [], []
            for i in range(batch.num_rows):
                size = rows["size"][i]
                if rows["full"][i] or not rows["hits"][i]:
                    lo.append(rows["lo"][i])
                    hi.append(rows["hi"][i])
                    share.append(1.0 if size else None)
                    continue
                places = [(d + k, k) for x in rows["hits"][i] for d, v in ((x["diagonal"], x["votes"]),) for k in range(v.bit_length()) if v >> k & 1]
                errors, start, end = align(places, size)
                lo.append(start)
                hi.append(end - 1)
                share.append(max(0.0, 1 - errors / size))
            columns = [c for n, c in zip(names, batch.columns) if n not in ("hits", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(share, pa.float64())], [*[n for n in names if n not in ("hits", "lo", "hi")], "lo", "hi", "share"])

    kept = [f"{n} {t}" for n, t in spans.dtypes if n not in ("hits", "lo", "hi")]
    return spans.mapInArrow(run, ", ".join([*kept, "lo long", "hi long", "share double"]))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", *, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Licenses named in every whole text, one row per row of docs.

    Returns key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans,
    an array of (label, template, first_word, last_word, share). A null text counts as empty:
    no words, empty labels, score 0. Keys may be null or repeat; further columns are left out.
    """
    spark = docs.sparkSession
    light_batches(docs.sparkSession)
    source = pick(docs, key=key, text=text)
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            off, data = utf8_view(batch.column(1))
            for i, j in groups(off):
                seg = _LOWER[data[off[i] : off[j]]]
                bounds = off[i : j + 1] - off[i]
                starts, hashes = hash_words(seg, bounds)
                pairs = pair_hashes(hashes) if len(hashes) > 1 else np.zeros(0, np.int64)
                at = np.searchsorted(starts, bounds).tolist()
                mark = np.array([_MARK], np.int64)
                index, ids, counts, places, parts = [], [], [], [], []
                for d in range(j - i):
                    row += 1
                    w0, w1 = at[d], at[d + 1]
                    for c in range(w0, max(w0 + 1, w1 - 1), _CHUNK):
                        first = c == w0
                        index.append(i + d)
                        ids.append(row)
                        counts.append(w1 - w0)
                        places.append(c - w0 - first)
                        if first:
                            parts.append(mark)
                        parts.append(pairs[c : max(c, min(c + _CHUNK, w1 - 1))])
                        if first:
                            parts[-2:] = [np.concatenate(parts[-2:])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(index)), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts))),
                    ], ["key", "row", "n_words", "base_at", "pairs"],
                )

    grams = source.mapInArrow(run, f"key {kind}, row long, n_words long, base_at long, pairs array<long>")
    index = spark.createDataFrame(template_rows(base, templates), "pair long, template int, place int, vote long, base boolean, label string, size int, whole long")
    hits = grams.select("key", "row", "n_words", "base_at", F.posexplode("pairs").alias("i", "pair")).join(
        F.broadcast(index), "pair"  # of a fixed size: the templates
    )
    same = ["key", "row", "n_words", "template", "base", "label", "size", "whole"]
    hits = hits.withColumn("at", F.col("base_at") + F.col("i"))
    diagonals = hits.groupBy(*same, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or("vote").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    # A diagonal with all votes is a span by itself; the others are merged with their neighbours.
    full = (F.col("votes") == F.col("whole")) | (F.col("template") < 0)
    order = Window.partitionBy("row", "template", "full").orderBy("diagonal")
    diagonals = diagonals.withColumn("full", full)

    def near(k: int):
        """Whether a row and the k-th before it are neighbours: in diagonals, and in words either way."""
        before = {c: F.lag(c, k).over(order) for c in ("lo", "hi", "diagonal")}
        gap = F.greatest(F.col("lo") - before["hi"], before["lo"] - F.col("hi"))
        return F.coalesce((F.col("diagonal") - before["diagonal"] <= DIAGONAL_STEP) & (gap <= GAP), F.lit(False))

    # Within DIAGONAL_STEP of a row are the two before it at most; a row between two neighbours goes with them.
    diagonals = diagonals.withColumn("near1", near(1)).withColumn("near2", near(2))
    apart = F.col("full") | ~(F.col("near1") | F.col("near2") | F.coalesce(F.lead("near2").over(order), F.lit(False)))
    diagonals = diagonals.withColumn("span", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A word replaced or left out takes two votes: a span that could verify has this share of them.
    enough = F.bit_count("votes") >= (F.col("size") - 1) - 2 * F.floor(F.col("size") * (1 - VERIFIED) + 1e-9)
    spans = diagonals.groupBy(*same, "full", "span").agg(
        F.bit_or("votes").alias("votes"), F.min("diagonal").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_list(F.when(~F.col("full") & ~F.col("base"), F.struct("diagonal", "votes"))).alias("hits"),
    )
    spans = spans.where(F.col("full") | (~F.col("base") & enough))
    spans = _verify(spans.select("row", "key", "n_words", "template", "base", "label", "size", "full", "start", "lo", "hi", "hits"), kind)
    good = (F.col("template") >= 0) & (F.col("full") | (F.col("share") >= VERIFIED - 1e-9))
    place = good & F.col("base")
    labels = lambda which: F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")))))
    return spans.groupBy("row", "key", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
        labels(place).alias("base_labels"), labels(good).alias("labels"), F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct(F.col("lo").alias("first_word"), (F.col("hi") + 1).alias("last_word"), "label", "template", "share")))).alias("spans"),
    ).drop("row").withColumnRenamed("key", key)


def op1_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")


_PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """(words, base places) of one text by plain comparison; the tests' yardstick."""
    words = _PLAIN_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for label, phrase in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)
