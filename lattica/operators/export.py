"""Exports of notes: bundles, outlines, bibliographies, JSON and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import citation_key, escape_bibtex, escape_quotes, format_tags

from .relational import numbered


def bundle(notes: DataFrame) -> DataFrame:
    """(place, section) of each note in export order. Ids alone are put in order; bodies join their places after."""
    placed = numbered(notes.select("id", "created"), [F.col("created").asc_nulls_last(), "id"]).drop("created")
    return notes.join(placed, "id").select("place", F.concat(F.lit("## "), F.col("title"), F.lit(" ("), F.col("id"), F.lit(")\n\n"), F.col("body"), F.lit("\n")).alias("section"))


def outline(notes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(place, section): the root, then what it links to in link order."""
    ways = edges.filter(F.col("src") == root).groupBy(F.col("dst").alias("id")).agg((F.min("position") + 1).alias("place"))
    first = notes.filter(F.col("id") == root).select("id", F.lit(0).alias("place"))
    return first.unionByName(ways).join(notes.select("id", "title", "body"), "id").select("place", F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body")).alias("section"))


def bibliography(sources: DataFrame, style: str) -> DataFrame:
    """(place, entry) of sources (url, title, accessed, note_title) by URL: markdown, bibtex or csl-json."""
    s = numbered(sources, ["url", "note_title"])
    if style == "markdown":
        entry = F.concat(F.coalesce(F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")")), F.concat(F.lit("- "), F.col("url"))), F.coalesce(F.concat(F.lit(" (accessed "), F.col("accessed"), F.lit(")")), F.lit("")), F.lit(" — from: "), F.col("note_title"))
    elif style == "bibtex":
        entry = F.concat(F.lit("@misc{"), citation_key(F.col("url"), F.col("place")), F.lit(",\n"), F.coalesce(F.concat(F.lit("  title = {"), escape_bibtex(F.col("title")), F.lit("},\n")), F.lit("")), F.lit("  url = {"), F.col("url"), F.lit("},\n  note = {From: "), escape_bibtex(F.col("note_title")), F.lit("}\n}\n"))
    else:
        entry = F.to_json(F.struct(F.concat(F.lit("source-"), F.col("place").cast("string")).alias("id"), F.lit("webpage").alias("type"), "title", F.col("url").alias("URL")))
    return s.select("place", entry.alias("entry"))


def as_json(notes: DataFrame) -> DataFrame:
    return notes.select("id", F.to_json(F.struct("id", "title", "type", "tags")).alias("json"))


def records(notes: DataFrame) -> DataFrame:
    return notes.select("id", F.concat(F.lit("N "), F.col("id"), F.lit(" "), F.col("type"), F.lit(' "'), escape_quotes(F.col("title")), F.lit('" tags='), format_tags(F.col("tags"))).alias("line"))
