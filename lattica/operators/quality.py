"""Checks of a store; each gives (severity, category, note_id, detail) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.model import INVERSES, NOTE_TYPES

from . import relational as R
from .compaction import conflicts, cycles
from .graph import on_cycles


def issue(rows: DataFrame, severity: str, category: str, note: str | Column = "id", detail: Column | None = None) -> DataFrame:
    where = F.col(note) if isinstance(note, str) else note
    return rows.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), where.alias("note_id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def missing_files(notes: DataFrame, files: DataFrame) -> DataFrame:
    return issue(notes.join(files, "id", "left_anti"), "error", "missing-file")


def duplicate_ids(notes: DataFrame) -> DataFrame:
    return issue(notes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "error", "duplicate-id", detail=F.col("n"))


def broken_links(unresolved: DataFrame) -> DataFrame:
    return issue(unresolved, "error", "broken-link", "src", F.col("target_ref"))


def semantic_misuse(edges: DataFrame) -> DataFrame:
    """Typed links to oneself, pairs that conflict, and circles of follows."""
    typed = edges.filter("not inline")
    own = typed.filter((F.col("src") == F.col("dst")) & F.col("link_type").isin("same-as", "alias-of", "part-of"))
    circles = on_cycles(typed.filter("link_type = 'follows'"))
    out = issue(own, "warning", "semantic-link-misuse", "src", F.col("link_type")).unionByName(issue(R.semantic_conflicts(edges), "warning", "semantic-link-misuse", "src", F.col("dst")))
    return out.unionByName(issue(circles, "warning", "semantic-link-misuse", detail=F.lit("follows")))


def missing_fields(notes: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return issue(notes.filter(blank("id") | blank("title")), "error", "missing-field")


def invalid_values(notes: DataFrame) -> DataFrame:
    return issue(notes.filter("value > 100"), "error", "invalid-value", detail=F.col("value"))


def large_metadata(custom: DataFrame, most: int = 10 * 1024) -> DataFrame:
    """Notes whose custom metadata (id, custom) are larger than most bytes; a column bytes in place of custom holds sizes that are known without the texts."""
    size = F.col("bytes") if "bytes" in custom.columns else F.octet_length("custom")
    return issue(custom.filter(size > most), "warning", "large-custom-metadata", detail=size)


def attachments(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """References to files (name) that aren't there, and files that nothing refers to; bodies: id, body."""
    refs = bodies.select("id", F.explode(X.attachments(F.col("body"))).alias("name"))
    broken = issue(refs.join(files, "name", "left_anti"), "error", "broken-attachment", detail=F.col("name"))
    orphans = issue(files.join(refs, "name", "left_anti"), "warning", "orphaned-attachment", F.lit(None).cast("string"), F.col("name"))
    return broken.unionByName(orphans)


def compaction_invariants(compacts: DataFrame) -> DataFrame:
    return issue(conflicts(compacts).unionByName(cycles(compacts)), "error", "compaction-invariant", detail=F.col("problem"))


def bare_link_lists(bodies: DataFrame) -> DataFrame:
    """The first list line of each note that has links and less than 20 bytes besides."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("line", "x")).withColumn("x", F.trim("x")).filter(F.col("x").rlike(r"^[-*] ") & F.col("x").rlike(r"\[\[[^\]]+\]\]"))
    rest = F.trim(F.regexp_replace(F.substring("x", 3, 1 << 30), r"\[\[[^\]]+\]\]", ""))
    first = lines.filter(F.octet_length(rest) < 20).groupBy("id").agg((F.min("line") + 1).alias("line"))
    return issue(first, "warning", "bare-link-list", detail=F.col("line"))


def orphaned_aliases(aliases: DataFrame, tags: DataFrame) -> DataFrame:
    """Canonical tags of aliases (alias, canonical) that no note has."""
    gone = aliases.select(F.col("canonical").alias("tag")).distinct().join(tags.select("tag").distinct(), "tag", "left_anti")
    return issue(gone, "warning", "orphaned-tag-alias", F.lit(None).cast("string"), F.col("tag"))


def complexity(notes: DataFrame, words: int = 1500, paragraphs: int = 50) -> DataFrame:
    counted = notes.select("id", X.words(F.col("body")).alias("w"), X.paragraphs(F.col("body")).alias("p"))
    detail = F.when(F.col("w") > words, F.concat(F.col("w"), F.lit(" words"))).otherwise(F.concat(F.col("p"), F.lit(" paragraphs")))
    return issue(counted.filter((F.col("w") > words) | (F.col("p") > paragraphs)), "warning", "note-complexity", detail=detail)


def empty_collections(notes: DataFrame, edges: DataFrame) -> DataFrame:
    return issue(notes.filter("type = 'moc'").join(edges.select(F.col("src").alias("id")), "id", "left_anti"), "warning", "empty-moc")


def near_duplicates(pairs: DataFrame) -> DataFrame:
    return issue(pairs, "warning", "near-duplicate", "id_a", F.col("id_b"))


def copies(of: DataFrame) -> DataFrame:
    """Notes (id, rep) whose text another one has already."""
    return issue(of.filter("id <> rep"), "warning", "near-duplicate", "rep", F.col("id"))


def unknown_types(notes: DataFrame, edges: DataFrame) -> DataFrame:
    n = issue(notes.filter(~F.col("type").isin(NOTE_TYPES)), "error", "invalid-note-type", detail=F.col("type"))
    return n.unionByName(issue(edges.filter(~F.col("link_type").isin(list(INVERSES))), "error", "invalid-link-type", "src", F.col("link_type")))


def severities(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def fixed(notes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values clamped to 100, and links without those whose target is gone."""
    clamped = notes.withColumn("value", F.when(F.col("value") > 100, 100).otherwise(F.col("value")))
    return clamped, links.join(notes.select(F.col("id").alias("dst")), "dst", "left_semi")
