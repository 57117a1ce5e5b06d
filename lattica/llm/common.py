"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.storage import full_address, new_path, open_store, written

__all__ = ["BLANKS", "WORD", "batches", "blank_if_null", "full_address", "grouped", "new_path", "open_store", "table", "words_of", "written"]

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever store the session can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    for c in BLANKS[1:]:
        text = text.replace(c, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


#: Bytes of a batch that a task works on at once.
PIECE_BYTES = 1 << 22


def batches(fn, schema: str | T.StructType):
    """fn(dict of column lists, rows) -> dict of column lists, as a function for mapInArrow. A batch is worked on in pieces of about PIECE_BYTES, so a worker holds the results of one piece only; what Arrow keeps of a batch that is done goes back to the system, since the worker lives on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    to = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            rows = max(1, whole.num_rows * PIECE_BYTES // max(whole.nbytes, 1))
            for at in range(0, max(whole.num_rows, 1), rows):
                b = whole.slice(at, rows)
                out = fn({n: b.column(i) for i, n in enumerate(b.schema.names)}, b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in to], schema=to)
            whole = b = out = None
            pa.default_memory_pool().release_unused()

    return run


def grouped(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in a stream that is sorted by them. Each run is held whole, so callers bound its length beforehand."""

    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and rows[lo] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = rows[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


def blank_if_null(c) -> F.Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(c.cast("string"), F.lit(""))
