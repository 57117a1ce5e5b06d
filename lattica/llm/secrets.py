"""Secret scans with multipart credential linking.

Strong patterns are reported as they are. Weak candidates (short or unlabelled tokens, account identifiers, endpoints)
are reported only where complementary parts co-occur within a scope: an identifier with a secret, a secret with an
identifier or an endpoint, an endpoint with a secret. The scope of a part is the block of settings that it stands in,
however long: a run of two lines or more that each begin with a name and ":" or "=", or with a bracket. In running text it
is what lies within REACH code points. No scope goes beyond an empty line.

Links are an interval join of parts with the scopes of their complements. Its key, the text, never leaves a row, so each
row is joined on its own by a search in sorted starts and the running maximum of ends: no shuffle, and no pairs are
written out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table

KINDS = ("assign", "access", "hex", "id", "weak", "endpoint")
REACH = 200
# Fixed patterns and least lengths of the base scan.
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("passw", "secret", "token", "api")
# Weak parts; only what a standard bounds (numbers of an address, labels of a host name) has an upper length.
_ID = re.compile(r"""\bA[KS]IA[A-Z0-9]{6,}|\b(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_ID_HINTS = ("akia", "asia", "_id", "clientid", "keyid", "accountid", "user", "login")
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}+){1,126}+:[0-9]{2,5}\b""", re.A)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
_SETTING = re.compile(r"""[\x20\t]*(?:[\[\]{}()]|(?:export[\x20\t]+|[-#;/*]{1,3}[\x20\t]*)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*[:=])""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong patterns, by start, then kind."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(token: str) -> bool:
    """Letters of both cases, or letters beside digits, with varied characters: what a key looks like and a word doesn't."""
    digits, low, up = (sum(map(f, token)) for f in (str.isdigit, str.islower, str.isupper))
    return len(set(token)) >= 8 and digits >= 2 and (low >= 2 or up >= 2)


class _Intervals:
    """Intervals of one role, for the question whether one of them meets a range."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def meet(self, low: int, high: int) -> bool:
        i = bisect_right(self.starts, high)
        return i > 0 and self.ends[i - 1] >= low


def parts_of(text: str, base: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """Weak candidates by kind (id, weak, endpoint), and what they may be linked to: all names and all secrets."""
    low = text.lower()
    ids = [(m.start(), m.end()) for m in _ID.finditer(text)] if any(h in low for h in _ID_HINTS) else []
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if ":" in text else []
    strong_ids = [(s, e) for s, e, k in base if k == "access"]
    if not (ids or ends or strong_ids):
        return {}
    strong = [(s, e) for s, e, k in base if k == "assign" or k == "hex" and not text[s:e].isdigit()]
    taken = _Intervals([(s, e) for s, e, _ in base])
    others = _Intervals([(s, e) for s, e, _ in base] + ids + ends)
    weak = [(m.start(), m.end()) for m in _WEAK.finditer(text) if _mixed(m[0]) and not others.meet(m.start() + 1, m.end() - 1)]
    weak += [(m.start(), m.end()) for m in _ASSIGN.finditer(text) if 6 <= len(m[2]) < 12] if any(h in low for h in _HINTS) else []
    ids = [x for x in ids if not taken.meet(x[0] + 1, x[1] - 1)]
    return {"id": ids, "weak": weak, "endpoint": ends, "names": strong_ids + ids, "secrets": strong + weak}


def settings(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of two lines or more that are settings."""
    starts, ends, at, lines = [], [], 0, 0
    for line in text.split("\n"):
        lines = lines + 1 if _SETTING.match(line) else 0
        if lines == 1:
            first = at
        elif lines == 2:
            starts.append(first)
            ends.append(at + len(line))
        elif lines:
            ends[-1] = at + len(line)
        at += len(line) + 1
    return starts, ends


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The weak candidates with a complementary part in their scope."""
    parts = parts_of(text, base)
    if not parts or not (parts["secrets"] and (parts["names"] or parts["endpoint"])):
        return []
    breaks = [m.end() for m in _SCOPE_END.finditer(text)]
    starts, ends = settings(text)
    secrets, names, points = (_Intervals(parts[k]) for k in ("secrets", "names", "endpoint"))

    def near(span: tuple[int, int], *others: _Intervals) -> bool:
        i = bisect_right(breaks, span[0])
        low, high = (breaks[i - 1] if i else 0), (breaks[i] if i < len(breaks) else len(text))
        first, last = span[0] - REACH, span[1] + REACH
        k = bisect_right(starts, span[0]) - 1
        if k >= 0 and span[0] < ends[k]:
            first, last = min(first, starts[k]), max(last, ends[k])
        return any(o.meet(max(low, first), min(high - 1, last)) for o in others)

    out = [(*x, "id") for x in parts["id"] if near(x, secrets)] + [(*x, "weak") for x in parts["weak"] if near(x, names, points)]
    return out + [(*x, "endpoint") for x in parts["endpoint"] if near(x, secrets)]


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of the first."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redact_to: str | None = None) -> DataFrame:
    """Spans of secrets in every whole text, in code points, and with redact_to the redacted text under that name.

    A null text counts as empty and stays null when redacted; repeated rows are scanned alike; an empty table gives an
    empty one; columns outside keep, whatever their names, play no part. One pass, no shuffle.
    """
    found = ["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]
    kept = [c for c in keep if c not in found and c != redact_to]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = source.select(*(F.col(f"`{c}`") for c in kept)).schema
    for c in found:
        schema = schema.add(c, "long" if c[:2] == "n_" else "string")
    if redact_to:
        schema = schema.add(redact_to, "string")

    def step(cols: dict, rows: int) -> dict:
        out: dict[str, list] = {c: [] for c in [*found, *([redact_to] if redact_to else [])]}
        for x in cols["__text"]:
            text = x.as_py()
            base = base_spans(text or "")
            more = linked_spans(text or "", base)
            spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["n_linked"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(spelled(base).encode()).hexdigest())
            out["spans"].append(spelled(spans))
            if redact_to:
                out[redact_to].append(text if text is None else redacted(text, spans))
        return {c: cols[c] for c in kept} | out

    return source.mapInArrow(batches(step, schema), schema)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents, with secrets replaced in their texts; n_chars, where there is one, follows."""
    columns = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != text_col)).alias("__row"), F.col(f"`{text_col}`"))
    done = scan(inner, text_col, keep=("__row",), redact_to="__clean")
    pick = lambda c: F.col("__clean") if c == text_col else F.char_length("__clean").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("__row").getField(c)
    return done.select(*(pick(c).alias(c) for c in columns))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan(table(spark, sf_dir, "documents"))
