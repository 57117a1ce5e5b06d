"""Chat formatting by schema fingerprints.

The fingerprint of a layout is a hash of its sorted nested field paths, as far as these are known to the mappings; it
selects a declarative mapping that says where key, order, role and content of canonical turns lie. Where no mapping has
exactly these paths, the one with the most paths among those that lie in the record whole is taken. Records of many
layouts may stand side by side as JSON; a table's own columns are a layout too.

The template marks turns by control strings that begin with "<|". Inside roles and contents, "<", any number of
backslashes and "|" get one backslash more, so that no text can hold a control string, and reading takes it away again.
Each turn is a piece of the formatted conversation on a row of its own, in order, so a conversation of any length streams
through bounded memory: rows are dealt out by conversation and sorted in their partitions, which can spill.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
PIECE = re.compile(r"<\|turn\|>(.*?)<\|say\|>(.*?)<\|end\|>\n", re.S)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where turns lie. each: path of the array of turns, or None if fields are turns of their own, as (role, path) in fields."""

    name: str
    paths: tuple[str, ...]
    each: str | None = None
    role: str = ""
    content: str = ""
    fields: tuple[tuple[str, str], ...] = ()


MAPPINGS = [
    Mapping("rows by turn", ("conv_id", "turn", "role", "text"), role="role", content="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("prompt and messages", ("prompt", "messages[].role", "messages[].content"), "messages", "role", "content", (("system", "prompt"),)),
    Mapping("system and messages", ("system", "messages[].role", "messages[].content"), "messages", "role", "content", (("system", "system"),)),
    Mapping("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system and instruction", ("system", "instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("system, instruction and input", ("system", "instruction", "input", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths) -> str:
    """Hash of the known ones among nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def mapping_for(paths, by_row: bool = False) -> Mapping | None:
    """The mapping with the paths' fingerprint, or else the largest one of which all paths are there, the first of equal ones; by_row: of rows by turn."""
    paths = set(paths) & KNOWN
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact is not None and (exact.name == "rows by turn") == by_row:
        return exact
    return max((m for m in MAPPINGS if (m.name == "rows by turn") == by_row and paths.issuperset(m.paths)), key=lambda m: len(m.paths), default=None)


def schema_paths(schema: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a Spark type."""
    if isinstance(schema, T.StructType):
        for f in schema:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(schema, T.ArrayType):
        yield from schema_paths(schema.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a parsed record."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
    else:
        yield at


def record_paths(record: dict) -> Iterator[str]:
    """Nested field paths of a parsed record; an array of turns has the paths of its turns, whatever their contents are, even if it is empty."""
    for m in MAPPINGS:
        if m.each and isinstance(turns := record.get(m.each), list):
            fields = {k for x in turns if isinstance(x, dict) for k in x} if turns else {m.role, m.content}
            yield from (f"{m.each}[].{k}" for k in fields)
    yield from (str(k) for k in record)
    yield from value_paths(record)


def said(v) -> str:
    """A content as text: null is empty, and of content parts the texts are joined if every part has one; else it is JSON."""
    if isinstance(v, list) and v and all(isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str) for x in v):
        return "".join(x if isinstance(x, str) else x["text"] for x in v)
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def turns_of(record) -> list[tuple[str, str]] | None:
    """Canonical (role, text) turns of a parsed record; None if no mapping's paths are all in it. Null texts are empty; empty fields give no turn."""
    if not isinstance(record, dict):
        return None
    m = mapping_for(record_paths(record))
    if m is None:
        return None
    text = said
    out = [(role, text(record[path])) for role, path in m.fields if text(record.get(path))]
    for x in record[m.each] if m.each else ():
        if isinstance(x, dict):
            role = text(x.get(m.role))
            out.append((ROLES.get(role, role), text(x.get(m.content))))
    return out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn's part of the formatted conversation, and where the loss applies in it: the assistant's text."""
    head, body = f"{TURN}{escape(role)}{SAY}", escape(text)
    return f"{head}{body}{END}\n", len(head) if role == "assistant" else 0, len(head) + len(body) if role == "assistant" else 0


def read_pieces(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation, or a piece of it, holds."""
    return [(unescape(m[1]), unescape(m[2])) for m in PIECE.finditer(formatted)]


PIECES = "conv_id {key}, seq long, formatted string, loss_start long, loss_end long"


def _piece_batch(keys, seqs, roles, texts, key_type: pa.DataType) -> pa.RecordBatch:
    made = [piece(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    cols = [pa.array(keys, key_type), pa.array(seqs, pa.int64()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["conv_id", "seq", "formatted", "loss_start", "loss_end"])


def format_rows(turns: DataFrame) -> DataFrame:
    """Formatted pieces (conv_id, seq, formatted, loss_start, loss_end) of a table in the layout of rows by turn.

    Turns of one number are ordered by role, then text, nulls first; seq counts from 0. Null roles and texts are empty,
    null conv_ids one conversation; repeated rows are turns of their own; extra columns play no part; an empty table gives
    an empty one. One shuffle by conversation; the sorted partitions stream, so no conversation is held whole.
    """
    m = mapping_for(schema_paths(turns.schema), by_row=True)
    if m is None:
        raise ValueError("the columns belong to no layout of rows by turn")
    rows = turns.select("conv_id", "turn", F.col(m.role).cast("string").alias("role"), F.col(m.content).cast("string").alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = object(), 0
        for b in it:
            keys, seqs = b.column(0).to_pylist(), []
            for k in keys:
                seq = seq + 1 if k == last else 0
                last = k
                seqs.append(seq)
            yield _piece_batch(keys, seqs, b.column(2).to_pylist(), b.column(3).to_pylist(), b.schema.field(0).type)

    return rows.mapInArrow(run, PIECES.format(key=turns.schema["conv_id"].dataType.simpleString()))


def read_record(record: str | None) -> tuple[list[tuple[str, str]], str]:
    """The turns of a JSON record, and its status: ok, null, not JSON, unknown layout, or no turns."""
    if record is None:
        return [], "null"
    try:
        turns = turns_of(json.loads(record))
    except (ValueError, RecursionError):
        return [], "not JSON"
    return turns or [], "unknown layout" if turns is None else "ok" if turns else "no turns"


def unmatched(records: DataFrame, key_col: str, json_col: str) -> DataFrame:
    """(conv_id, record, status) of every record of which format_records gives no piece, repeated ones each."""
    rows = records.select(F.col(f"`{key_col}`").alias("conv_id"), F.col(f"`{json_col}`").cast("string").alias("record"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            status = [read_record(x)[1] for x in b.column(1).to_pylist()]
            left = [i for i, s in enumerate(status) if s != "ok"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(left, pa.int64())), b.column(1).take(pa.array(left, pa.int64())), pa.array([status[i] for i in left], pa.string())], ["conv_id", "record", "status"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("status", T.StringType())]))


def format_records(records: DataFrame, key_col: str, json_col: str) -> DataFrame:
    """Formatted pieces of JSON records of any known layout; those of others are in unmatched()."""
    rows = records.select(F.col(f"`{key_col}`").alias("conv_id"), F.col(f"`{json_col}`").cast("string").alias("record"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, seqs, roles, texts = [], [], [], []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, (role, text) in enumerate(read_record(x)[0]):
                    keys.append(k)
                    seqs.append(i)
                    roles.append(role)
                    texts.append(text)
            yield _piece_batch(keys, seqs, roles, texts, b.schema.field(0).type)

    return rows.mapInArrow(run, PIECES.format(key=rows.schema["conv_id"].dataType.simpleString()))


def digests(pieces: DataFrame) -> DataFrame:
    """What formatted pieces say when they are read back, as digests for each conversation.

    Loss text is what lies under the loss mask, unescaped. Pieces stream in order through running digests.
    """
    key = pieces.schema["conv_id"].dataType.simpleString()
    rows = pieces.select("conv_id", "seq", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list | None = None
        for b in it:
            done: list[list] = []
            for k, _, text, lo, hi in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or state[0] != k:
                    if state is not None:
                        done.append(state)
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_pieces(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                under = unescape(text[lo:hi])
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += len(text)
            if done:
                yield batch(done, names, b.schema.field(0).type)
            kind = b.schema.field(0).type
        if state is not None:
            yield batch([state], names, kind)

    def batch(states: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([s[i].hexdigest() if i in (2, 4) else s[i] for s in states], kind if i == 0 else pa.string() if i in (2, 4) else pa.int64()) for i in range(6)]
        return pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted pieces, and of one whose texts hold other templates' controls."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_rows(turns.unionByName(extra)))
