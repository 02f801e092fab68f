"""Language identification by bit-sliced Bloom filters of n-grams.

A slot of the filter holds one bit per language, so that the AND of an n-gram's
slots gives all languages that contain it. A text's hits per language are counted by
bit, corrected for the filters' false positives, and the largest decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, groups, light_batches, mix64, pick, table, utf8_view

#: Labelled documents per language that the filters are learned from, at most (expected).
TRAIN_DOCS = 3000
#: Languages that are learned, at most (those with most documents); n-grams of a language and of all languages together, at most (the
#: most frequent): the filters' capacity.
MAX_LANGUAGES, TOP_GRAMS, ALL_GRAMS = 1024, 1 << 18, 1 << 22
#: Bytes of an n-gram, hash functions, log2 of slots.
GRAM, HASHES, LOG_SLOTS = 4, 3, 22
#: An n-gram counts as contained in a language if its share there is at least this part of its largest share.
CONTAINED = 0.5
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageFilters:
    """languages: in code-point order. slots: (words, 2**LOG_SLOTS) of 64 language bits each."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray = field(default=None)

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray]) -> LanguageFilters:
        words = max(1, -(-len(languages) // 64))
        slots = np.zeros((words, 1 << LOG_SLOTS), np.uint8 if len(languages) <= 8 else np.uint64)
        for i, own in enumerate(grams):
            for at in slot_indexes(own.astype(np.uint64)):
                slots[i // 64, at] |= slots.dtype.type(1 << (i % 64))
        fill = [np.count_nonzero(slots[i // 64] & slots.dtype.type(1 << (i % 64))) / slots.shape[1] for i in range(len(languages))]
        return cls(languages, slots, np.array(fill) ** HASHES)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """(words, n): the languages that contain each n-gram, as bits."""
        out = None
        for at in slot_indexes(grams):
            got = self.slots[:, at]
            out = got if out is None else out & got
        return out

    def predict(self, text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score) of each text; text i is text[bounds[i]:bounds[i+1]]."""
        grams = grams_of(text)
        masks = self.masks(grams)
        lo, hi = bounds[:-1], np.maximum(bounds[1:] - GRAM + 1, bounds[:-1])
        total = (hi - lo).astype(float)
        hits = np.empty((len(self.languages), len(total)))
        for i in range(len(self.languages)):
            one = (masks[i // 64] & masks.dtype.type(1 << (i % 64))) != 0
            run = np.concatenate([[0], np.cumsum(one)])
            found = run[np.minimum(hi, len(grams))] - run[np.minimum(lo, len(grams))]
            hits[i] = np.maximum(0, found - total * self.rates[i]) / (1 - self.rates[i])
        best = hits.argmax(0)
        every = hits.sum(0)
        return best, np.where(every > 0, hits.max(0) / np.maximum(every, 1e-300), 0.0)


def slot_indexes(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram, one array per hash function (double hashing)."""
    h = mix64(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64((1 << LOG_SLOTS) - 1)
    step = (h >> np.uint64(LOG_SLOTS)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]


def grams_of(text: bytes) -> np.ndarray:
    """All n-grams of bytes, as numbers."""
    data = np.frombuffer(text, np.uint8)
    n = max(0, len(data) - GRAM + 1)
    out = np.zeros(n, np.uint32)
    for k in range(GRAM):
        out = (out << np.uint32(8)) | data[k : k + n]
    return out


def _padded(text: str | None) -> bytes:
    return f" {text.lower()}   ".encode("utf-8", "replace") if text else b"    "


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, train_docs: int = TRAIN_DOCS) -> LanguageFilters:
    """Filters of all languages among the rows' labels.

    Rows with a null text or label teach nothing. About train_docs documents per
    language are read, picked by a hash of key and text; whole texts are counted. What the driver
    gets is bounded by MAX_LANGUAGES and ALL_GRAMS.
    """
    rows = pick(docs, key=key, text=text, lang=lang).where("text is not null and lang is not null")
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").limit(MAX_LANGUAGES)
    languages = sorted((r["lang"], r["docs"]) for r in many.collect())
    if not languages:
        return LanguageFilters([], np.zeros((1, 1 << LOG_SLOTS), np.uint8), np.zeros(0))
    scale = 1 << 30
    shares = [(name, i, int(scale * min(1.0, train_docs / n))) for i, (name, n) in enumerate(languages)]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, at int, share long")
    # At most MAX_LANGUAGES rows.
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("key", "text"), F.lit(scale)) < F.col("share")).select("at", "text")

    def count(batches):
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(i, []).append(_padded(value.as_py()))
            for i, texts in by.items():
                start = 0
                for end in range(256, len(texts) + 256, 256):
                    grams, n = np.unique(np.concatenate([grams_of(t) for t in texts[start:end]]), return_counts=True)
                    start = end
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["at", "gram", "n"])

    counts = cut(sample.mapInArrow(count, "at int, gram long, n long").groupBy("at", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    totals = counts.groupBy("at").agg(F.sum("n").alias("total"))
    shared = counts.join(F.broadcast(totals), "at").withColumn("own", F.col("n") / F.col("total"))  # at most MAX_LANGUAGES rows
    most = F.max("own").over(Window.partitionBy("gram"))  # a row per language
    top = max(1, min(TOP_GRAMS, ALL_GRAMS // len(languages)))
    contained = shared.withColumn("most", most).where(F.col("own") >= CONTAINED * F.col("most"))
    ranked = contained.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    found = ranked.select("at", "gram").toPandas()
    grams = [found["gram"].to_numpy(np.int64)[(found["at"] == i).to_numpy()] for i in range(len(languages))]
    return LanguageFilters.build([name for name, _ in languages], grams)


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the carried columns, lang_pred and score.

    A null text, a text without a letter, and every text if nothing was learned get "und" and
    score 0. A text whose n-grams no filter knows gets the first language and score 0; ties go
    to the language that is first in code-point order.
    """
    light_batches(docs.sparkSession)
    # A text that is carried along is sent to the workers once.
    at = carry.index(text) if text in carry else len(carry)
    source = pick(docs, **{f"k{i}": c for i, c in enumerate(carry)}, **({} if text in carry else {"text": text}))
    fields = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(carry)))
    shared = source.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2**LOG_SLOTS slots
    n = len(carry)

    def run(batches):
        filters = shared.value
        for batch in batches:
            column = batch.column(at)
            off, _ = utf8_view(column)
            for i, j in groups(off, 1 << 18):
                names, scores = [], []
                texts = column.slice(i, j - i).to_pylist()
                whole = [_padded(t) for t in texts]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in whole])])
                letters = [bool(t) and _LETTER.search(t) is not None for t in texts]
                if not filters.languages:
                    letters = [False] * len(texts)
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                else:
                    best, score = filters.predict(b"".join(whole), bounds)
                names += [filters.languages[b] if ok else UNDETERMINED for ok, b in zip(letters, best.tolist())]
                scores += [s if ok else 0.0 for ok, s in zip(letters, score.tolist())]
                own = [c.slice(i, j - i) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*[f"k{i}" for i in range(n)], "lang_pred", "score"])

    got = source.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return got.toDF(*carry, "lang_pred", "score")


def held_out(key: str = "doc_id", folds: int = 5):
    """True where crc32 of the key as text leaves remainder 0; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def fit_on_rest(docs: DataFrame) -> LanguageFilters:
    """Filters learned from the documents that are not held out."""
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return fit(rows.where(~held_out()))


def op7_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on_rest(docs)
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("held_out", held_out())
    return predict(rows, model, carry=("doc_id", "held_out"))
