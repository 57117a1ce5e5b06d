"""Notes as markdown files with a YAML head."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import full_address, open_store, written

try:
    import yaml
except ImportError:  # then heads are read line by line
    yaml = None

#: The safe loader by libyaml where there is one; the one in Python takes many times as long for a head.
_LOADER = yaml and getattr(yaml, "CSafeLoader", yaml.SafeLoader)
#: A line of a head that YAML and JSON read alike, and the words that YAML takes for something else.
_FIELD = re.compile(r"([a-z_]+): (\".*\"|\[.*\]|null|0|[1-9][0-9]*|[A-Za-z][A-Za-z0-9_-]*)")
_SPECIAL = {"true", "false", "yes", "no", "on", "off", "y", "n"}
#: Tasks for each core that read files.
TASKS = 16
#: Files of a listing, and bytes of files, that a task holds at a time.
LISTED_AT_ONCE = 10_000
READ_AT_ONCE = 8 << 20
SCHEMA = "path string, id string, title string, type string, value int, tags array<string>, links array<struct<type: string, id: string>>, body string, error string"


def render(notes: DataFrame) -> Column:
    """A note as markdown; strings are quoted as JSON, which YAML reads. A note without a body ends with its head."""
    plain = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    head = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\ntitle: "), plain("title"), F.lit("\ntype: "), F.col("type"), F.when(F.col("value").isNotNull(), F.concat(F.lit("\nvalue: "), F.col("value").cast("string"))).otherwise(""), F.lit("\ntags: "), F.to_json("tags"), F.lit("\n---"))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n"), F.col("body")), F.lit("")))


def write(notes: DataFrame, root: str) -> DataFrame:
    """Writes a file for each note below a folder, named by its id, and gives back (id, path, bytes). Files are dealt out to 256 folders by a hash of the id, so that none holds them all. A file is written whole or replaced, so a repeated attempt leaves the same one."""
    base = full_address(notes.sparkSession, root)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(base)
        made = set()
        for b in it:
            sizes, paths = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, part = text.encode(), hashlib.md5(name.encode()).hexdigest()[:2]
                if part not in made:
                    store.create_dir(f"{folder}/{part}", recursive=True)
                    made.add(part)
                with store.open_output_stream(f"{folder}/{part}/{name}.md", compression=None) as f:
                    f.write(raw)
                sizes.append(len(raw))
                paths.append(f"{base}/{part}/{name}.md")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["id", "path", "bytes"])

    return written(notes.select("id", render(notes).alias("text")).mapInArrow(run, "id string, path string, bytes long"), "files")


def _plain_head(text: str) -> dict | None:
    """The fields of a head of lines as render() writes them, a name and a JSON string, list of strings, null, whole number or plain word each; null for any other. YAML reads these the same, but refuses or folds some letters that JSON lets stand."""
    out = {}
    for line in text.split("\n"):
        found = _FIELD.fullmatch(line)
        if not found or found[2].lower() in _SPECIAL:
            return None
        value = found[2]
        if value[0] in '["':
            try:
                value = json.loads(value)
                "".join(x or "" for x in value).encode()  # half a pair of surrogates is no text
            except (TypeError, ValueError):
                return None
            if isinstance(value, list) and not all(x is None or isinstance(x, str) for x in value):
                return None
        elif value[0].isdigit():
            value = int(value)
        elif value == "null":
            value = None
        elif value.lower() == "null":
            return None
        out[found[1]] = value
    return out


def _head(text: str) -> dict:
    if (plain := _plain_head(text)) is not None:
        return plain
    if yaml is not None:
        found = yaml.load(text, Loader=_LOADER)
        if not isinstance(found, dict):
            raise ValueError("the head is no mapping")
        return found
    out = {}
    for line in text.splitlines():
        key, _, value = line.partition(":")
        try:
            out[key.strip()] = json.loads(value)
        except ValueError:
            out[key.strip()] = value.strip()
    return out


def _whole_number(x) -> int | None:
    if x is None or isinstance(x, int) and not isinstance(x, bool) and -(2**31) <= x < 2**31:
        return x
    raise ValueError(f"value is no whole number: {x}")


def _listed(fields: dict, name: str) -> list:
    x = fields.get(name) or []
    if not isinstance(x, list):
        raise ValueError(f"{name} is no list: {x}")
    return x


def parse_note(path: str, text: str) -> dict:
    """One file's fields; error says why it is no note. A title must be given, but may be empty, as that of a note that begins with an empty line; no head's end but its mark makes a body null."""
    row = dict.fromkeys(("id", "title", "type", "value", "tags", "links", "body", "error")) | {"path": path}
    try:
        if not text.startswith("---\n"):
            raise ValueError("no head")
        head, mark, body = text[4:].partition("\n---\n")
        if not mark:
            if not head.endswith("\n---"):
                raise ValueError("the head doesn't end")
            head, body = head[:-4], None
        fields = _head(head)
        if not fields.get("id") or "title" not in fields:
            raise ValueError("id or title is missing")
        title = fields["title"]
        links = [{"type": str(x.get("type", "related")), "id": str(x.get("id"))} for x in _listed(fields, "links")]
        row |= {"id": str(fields["id"]), "title": None if title is None else str(title), "type": str(fields.get("type", "fleeting")).lower(), "value": _whole_number(fields.get("value")), "tags": [None if t is None else str(t) for t in _listed(fields, "tags")], "links": links, "body": body}
    except Exception as e:  # noqa: BLE001  any bad file is a row with its error
        row["error"] = str(e)[:200]
    return row


def parse(files: DataFrame) -> DataFrame:
    """Notes of files (path, text), bad ones with an error and no fields."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("path", "id", "title", "type", "value", "tags", "links", "body", "error")]
        for b in it:
            out = pd.DataFrame([parse_note(p, t) for p, t in zip(b["path"], b["text"], strict=True)], columns=names)
            out["value"] = out["value"].astype("Int32")
            yield out

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path", "length", "modificationTime")


def _below(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below a folder, whose names end in .md and don't begin with a dot or an underscore. Folders are listed by tasks, level by level, so that the driver holds no list of files."""

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for folder in b.column(0).to_pylist():
                store, name = open_store(folder)
                base, found = folder.rstrip("/"), []
                for entry, is_folder in _entries(store, name):
                    if not entry.startswith((".", "_")) and (is_folder or entry.endswith(".md")):
                        found.append((f"{base}/{_quoted(folder, entry)}", is_folder))
                    if len(found) == LISTED_AT_ONCE:
                        yield _listing(found)
                        found = []
                yield _listing(found)

    top = full_address(spark, root)
    levels, folders = [], spark.createDataFrame([(_quoted(top, top),)], "path string")
    while True:
        level = written(folders.mapInArrow(listed, "path string, folder boolean"), "listing")
        levels.append(level.filter(~F.col("folder")).select("path"))
        number = level.filter("folder").count()
        if not number:
            return reduce(DataFrame.unionByName, levels)
        folders = level.filter("folder").select("path").repartition(min(number, spark.sparkContext.defaultParallelism * TASKS))


def _quoted(address: str, name: str) -> str:
    """A name as it stands in the address of a local file, which open_store() takes for a URI."""
    return quote(name, safe="/:") if address.startswith("file:") else name


def _listing(found: list[tuple[str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], ["path", "folder"])


def _entries(store, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder; local ones are streamed."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from ((e.name, e.is_dir()) for e in entries)
    else:
        yield from ((x.base_name, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(folder)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All notes below a folder, one file each, in whatever store Spark reads."""
    return parse(scan_raw(spark, root))


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the files below a folder. Tasks list the folder and stream the files, TASKS tasks for each core at most; Spark's own reader would keep the state of every file in the driver and count a small one as megabytes."""

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            paths, held, size = [], [], 0
            for path in b.column(0).to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as f:
                    raw = f.read()
                paths.append(path)
                held.append(raw.decode("utf-8", "replace"))
                size += len(raw)
                if size >= READ_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.string())], ["path", "text"])
                    paths, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.string())], ["path", "text"])

    return _below(spark, root).repartition(TASKS * spark.sparkContext.defaultParallelism).mapInArrow(texts, "path string, text string")
