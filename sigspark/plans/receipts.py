"""Digests, receipts and their verification."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no NaN: the text over which documents are hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest_json(value) -> str:
    """SHA-256 of the canonical text."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def short_digest(digest: str) -> str:
    """The first twelve digits."""
    return digest[:12]


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """A column of JSON texts in canonical form."""
    return text.map(lambda x: canonical_json(json.loads(x)), na_action="ignore")


def run_key(source_sha256: str, plan: dict) -> str:
    """The key of a run: what was read and what was asked for."""
    return digest_json({"source": source_sha256, "plan": plan})


def compare_digests(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status) of a full outer join on key: same, changed, missing or unexpected."""
    a, b = expected.select(F.col(key), F.col("sha256").alias("_e")), actual.select(F.col(key), F.col("sha256").alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_a") == F.col("_e"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))
