"""Text clouds of ``x y z r g b [...]`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phyllo.functions.scalars import clamp_color
from phyllo.sources.stores import opened


def _short(line: str) -> bool:
    text = line.replace(",", " ").strip()
    return bool(text) and not text.startswith("#") and len(text.split()) < 6


def read_text_cloud(spark: SparkSession, path: str) -> DataFrame:
    """``(uid, line_at, x, y, z, red, green, blue)``: commas count as blanks, empty lines and comments are passed over.

    A line with fewer than six columns raises with its number: a first pass looks
    for one, whose number is then counted in its file. ``line_at`` grows with the
    place in the file.
    """
    lines = spark.read.text(path).select("_metadata.file_path", F.trim(F.translate("value", ",\t", "  ")).alias("line"), F.monotonically_increasing_id().alias("line_at"))
    parts = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("p", F.split("line", " +"))
    wrong = parts.where(F.size("p") < 6).select("file_path").limit(1).collect()
    if wrong:
        with opened(wrong[0]["file_path"]) as f:
            at = next(i for i, line in enumerate(f, 1) if _short(line.decode("utf-8", "replace")))
        raise ValueError(f"{wrong[0]['file_path']}: line {at} has fewer than six columns")
    parts = parts.withColumn("_f", F.element_at(F.split("file_path", "/"), -1))
    xyz = [F.col("p")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return parts.select(F.regexp_replace("_f", r"\.[^.]*$", "").alias("uid"), "line_at", *xyz, *[clamp_color(F.col("p")[i + 3]).alias(c) for i, c in enumerate(("red", "green", "blue"))])
