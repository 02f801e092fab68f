"""A corpus pipeline over documents: language ID, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again
before the next stage. All but the last return the columns of docs as they came; columns
are handled by position, so that further ones may have any name. Nulls: a document with a null
text has no language and is rejected by the first stage; a null source is a source of its own;
null and repeated doc_ids are kept apart by their place in the table. An
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe, langid, mixing, near_copies, secret_scan
from sigspark.llm.common import cut, table


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns p0, p1, ... in place of their names, and those names."""
    return docs.toDF(*[f"p{i}" for i in range(len(docs.columns))]), docs.columns


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """_placed with a unique number "row". The numbered rows are written once: what reads them again, with other splits or after
    losing an executor, finds the same numbers."""
    rows, names = _placed(docs)
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"), names


def _at(names: list[str], name: str) -> str:
    return f"p{names.index(name)}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text or one without a letter."""
    rows, names = _placed(docs)
    model = langid.fit_on_rest(docs)
    found = langid.predict(rows, model, text=_at(names, "text"), carry=tuple(rows.columns))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*rows.columns).toDF(*names)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles at Jaccard 0.8 or more): the smallest
    doc_id, null last, then the first in the table."""
    rows, names = _numbered(docs)
    own = F.col(_at(names, "doc_id"))
    keyed = rows.withColumn("key", F.struct(own.isNull().alias("none"), own.alias("id"), "row"))
    dropped = cut(near_copies.dropped(keyed, _at(names, "text"), "key"), "dropped")
    # A merge join at every size: what is broadcast would grow with the corpus.
    return rows.join(dropped.hint("merge"), "row", "left_anti").select(*[f"p{i}" for i in range(len(names))]).toDF(*names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by [REDACTED]; n_chars follows the text. No document goes."""
    rows, names = _placed(docs)
    text = _at(names, "text")
    found = secret_scan.scan(rows, text=text, carry=tuple(c for c in rows.columns if c != text), redacted=True)
    out = {c: F.col("redacted" if c == text else c) for c in rows.columns}
    if "n_chars" in names:
        place = _at(names, "n_chars")
        changed = F.when(F.col("spans") != "", F.char_length("redacted")).otherwise(F.col(place))
        out[place] = changed.cast(rows.schema[place].dataType)
    return found.select(*[c.alias(k) for k, c in out.items()]).toDF(*names)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix takes them: a row per copy."""
    rows, names = _numbered(docs)
    taken = mixing.entropy_balance(rows, text=_at(names, "text"), source=_at(names, "source"), key="row")
    taken = cut(taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")), "copies")
    return rows.join(taken.hint("merge"), "row").select(*[f"p{i}" for i in range(len(names))]).toDF(*names)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secrets", secrets),
    ("source_mixing", source_mixing),
    ("bpe", bpe_round_trip),
]

#: SQL cannot express fingerprints, tilts and merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
