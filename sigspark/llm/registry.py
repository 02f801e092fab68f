"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hnsw, html_text, langid, license_scan, mixing, prefix_hash, secret_scan, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_diagonals": license_scan.op1_license_diagonals,
    "op2_html_paths": html_text.op2_html_paths,
    "op3_warc": warc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_bpe": bpe.op5_bpe,
    "op6_prefix_fingerprints": prefix_hash.op6_prefix_fingerprints,
    "op7_language_filters": langid.op7_language_filters,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_hnsw": hnsw.op9_hnsw,
    "op10_entropy_mixing": mixing.op10_entropy_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_warc": warc.ORACLE}
