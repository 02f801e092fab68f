"""File names and tags of tracks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expr import safe_name

#: Fields of a file name's template.
FIELDS = ("index", "title", "artist", "album_artist", "album", "year", "position", "catalog_number")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Texts in Unicode's composed form."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def default_title(index):
    """The title of a track without one."""
    return F.format_string("Track %02d", index)


def resolve_tags(tracks: DataFrame, tags: DataFrame) -> DataFrame:
    """Title, artist and album of every track: the track's own artist, then the album's, then the fallback."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    got = tracks.join(tags, "track_index", "left")
    return got.select("track_index", "title", F.coalesce(filled("track_artist"), filled("album_artist"), "fallback").alias("artist"), "album")


def render(tracks: DataFrame, template: str, extension: str) -> DataFrame:
    """tracks with filename and collides: the template's {fields} filled with safe components.

    {index} takes a width as in {index:02d}. A template with an unknown field is refused.
    """
    import string

    parts = []
    for text, field, spec, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is None:
            continue
        if field not in FIELDS or field not in tracks.columns:
            raise ValueError(f"unknown field {field!r} in template {template!r}")
        if field == "index":
            parts.append(F.format_string(f"%{spec or 'd'}", F.col("index")))
        else:
            parts.append(safe_name(nfc(F.col(field).cast("string"))))
    from pyspark.sql import Window

    named = tracks.withColumn("filename", F.concat(*parts, F.lit(f".{extension}")))
    return named.withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("filename")) > 1)
