"""Documentation files cut into sections, natively: one row per heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import base_lower, lines, nonblank, stem_of

BODY_CHARS = 800
HEADING = r"^(#{1,6})\s+(.+)$"


def doc_sections(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, ordinal, name, kind, parent_context, body_text, start_line, end_line``.

    One doc_section per heading of any level; its body reaches to the next heading, trimmed, at most 800
    characters, NULL if empty. A file without headings is one section named after its stem, with its first
    800 characters. Headings inside code fences count, as any line does. NULL content gives nothing, empty
    content one section without lines below 1. Extra columns are ignored.
    """
    f = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("_text"), lines(F.col(content)).alias("_lines"))
    f = f.withColumn("_heads", F.filter(F.transform("_lines", lambda s, i: F.struct((i + 1).alias("line"), F.regexp_extract(s, HEADING, 2).alias("name"), s.rlike(HEADING).alias("yes"))), lambda x: x["yes"]))
    stem = stem_of(F.substring_index("path", "/", -1))
    whole = f.where(F.size("_heads") == 0).select("path", F.lit(0).alias("ordinal"), stem.alias("name"), nonblank(F.substring("_text", 1, BODY_CHARS)).alias("body_text"), F.lit(1).alias("start_line"), F.greatest(F.size("_lines"), F.lit(1)).alias("end_line"))
    each = f.select("path", "_lines", "_heads", F.posexplode("_heads").alias("ordinal", "h"))
    following = F.coalesce(F.get("_heads", F.col("ordinal") + 1)["line"], F.size("_lines") + 1)
    body = F.array_join(F.slice("_lines", F.col("h.line") + 1, F.greatest(following - F.col("h.line") - 1, F.lit(0))), "\n")
    cut = each.select("path", F.col("ordinal").cast("int").alias("ordinal"), F.trim(F.col("h.name")).alias("name"), nonblank(F.substring(nonblank(body), 1, BODY_CHARS)).alias("body_text"), F.col("h.line").alias("start_line"), (following - 1).alias("end_line"))
    got = whole.unionByName(cut)
    return got.select("path", F.col("ordinal").cast("long").alias("ordinal"), "name", F.lit("doc_section").alias("kind"), F.col("path").alias("parent_context"), "body_text", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def toml_tables(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, ordinal, name, kind, start_line, end_line``: tables of TOML files by their header lines; bracketed
    lines that are values are none."""
    f = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), lines(F.col(content)).alias("_lines"))
    header = F.trim(F.col("_s"))
    rows = f.select("path", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_i", "_s")).withColumn("name", F.trim(F.regexp_replace(header, r"^\[+|\]+$", "")))
    rows = rows.where(header.rlike(r"^\[.*\]$") & F.col("name").rlike(r"""^[\p{L}\p{N}._\-"' ]+$"""))
    w = Window.partitionBy("path").orderBy("_i")
    end = F.coalesce(F.lead("_i").over(w), F.col("_n"))
    return rows.select("path", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "name", F.lit("table").alias("kind"), (F.col("_i") + 1).cast("long").alias("start_line"), F.greatest(end, F.col("_i") + 1).cast("long").alias("end_line"))


__all__ = ["base_lower", "doc_sections", "toml_tables"]
