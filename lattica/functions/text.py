"""Scalar functions over the text of notes, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import HALF_COST, INVERSES, STOP_WORDS

NO_WORD = r"[^\p{L}\p{N}]+"
WIKI = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MARKDOWN = r"\[([^\]]*)\]\(([^)]+)\)"
ATTACHMENT = r"attachments/([^)\s\n]+)"


def _simple_capitals() -> dict[str, str]:
    """Letters whose capitals are several letters, and the one letter that Unicode's simple mapping gives, mostly themselves."""
    many = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
    return {c: c.title() if len(c.title()) == 1 else c for c in many} | {"\u00df": "\u1e9e"}


def upper(text: Column) -> Column:
    """Capitals letter by letter as SQL gives them, so that a text keeps its length: \u1e9e for \u00df, not SS."""
    table = _simple_capitals()
    own = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.isin(*table), F.translate(c, "".join(table), "".join(table.values()))).otherwise(F.upper(c))), "")
    return F.when(text.rlike("[" + "".join(table) + "]"), own).otherwise(F.upper(text))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: (w != "") & ~F.array_contains(stop, w))


def _measure(word: str) -> int:
    """Number of vowel-consonant turns."""
    kinds = "".join("v" if c in "aeiou" or c == "y" and i and word[i - 1] not in "aeiou" else "c" for i, c in enumerate(word))
    turns = "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])
    return turns.lstrip("c").count("vc")


def _has_vowel(word: str) -> bool:
    return any(c in "aeiou" or c == "y" and i for i, c in enumerate(word))


def _short_end(word: str) -> bool:
    return len(word) > 2 and word[-1] not in "aeiouwxy" and (word[-2] in "aeiouy") and word[-3] not in "aeiou"


# Suffix tables of Porter's algorithm (1980), fixed values.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem(word: str) -> str:
    """Porter's stemmer for English words of plain letters; others stay as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(terms: DataFrame, term: str = "term", stemmer=stem) -> DataFrame:
    """(term, stem) of the different terms: the function runs once for each, to be joined back."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(stemmer)

    return terms.select(term).distinct().withColumn("stem", of(F.col(term)))


def wiki_links(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(WIKI), F.lit(1)), lambda x: F.trim(x))


def markdown_links(body: Column) -> Column:
    """Structs of text and target, images included."""
    each = lambda i: F.regexp_extract_all(body, F.lit(MARKDOWN), F.lit(i))
    return F.transform(F.arrays_zip(each(1).alias("t"), each(2).alias("u")), lambda x: F.struct(x["t"].alias("text"), x["u"].alias("target")))


def is_external(target: Column) -> Column:
    return target.rlike("^(https?://|#)")


def id_in_target(target: Column, prefix: str = "qp-") -> Column:
    """The first two dash parts from the id prefix on, without file endings."""
    found = F.regexp_extract(target, rf"({prefix}[^-./)\s]+)", 1)
    return F.when(found != "", found)


def attachments(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(ATTACHMENT), F.lit(1)))


def wiki_to_markdown(body: Column) -> Column:
    labelled = F.regexp_replace(body, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2]($1.md)")
    return F.regexp_replace(labelled, r"\[\[([^\]|]+)\]\]", "[$1]($1.md)")


def export_links(body: Column, mode: str) -> Column:
    """Wiki links kept, as links to files, or as links to anchors."""
    if mode == "preserve":
        return body
    if mode == "markdown":
        return wiki_to_markdown(body)
    labelled = F.regexp_replace(body, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2](#note-$1)")
    return F.regexp_replace(labelled, r"\[\[([^\]|]+)\]\]", "[$1](#note-$1)")


def strip_links(body: Column) -> Column:
    """Labels or targets in place of links."""
    bare = F.regexp_replace(F.regexp_replace(body, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")
    return F.regexp_replace(bare, MARKDOWN, "$1")


def rewrite_ids(body: Column, old: str, new: str) -> Column:
    return F.regexp_replace(body, rf"\b{old}\b", new)


def summary_section(body: Column) -> Column:
    """The first paragraph of the section Summary; null if there is none."""
    found = F.regexp_extract(body, r"(?:^|\n)## Summary[^\n]*\n(?:[ \t\r]*\n)*((?:(?!##? )[^\n]*\S[^\n]*(?:\n|$))+)", 1)
    return F.when(F.trim(found) != "", F.rtrim(F.regexp_replace(found, r"\s+$", "")))


def first_paragraph(body: Column) -> Column:
    """Lines up to the first empty one, after leading headings and empty lines; null if there are none."""
    rest = F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"^(?:#[^\n]*(?:\n|$)|[ \t\r]*\n)+", "")
    found = F.regexp_replace(F.regexp_extract(rest, r"^((?:[^\n]*\S[^\n]*(?:\n|$))+)", 1), r"\n$", "")
    return F.when(found != "", F.regexp_replace(found, "\n", " "))


def summary(given: Column, body: Column) -> Column:
    return F.coalesce(F.when(given != "", given), summary_section(body), first_paragraph(body), F.lit(""))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def short_id(text: Column, length: int = 4, prefix: str = "qp-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, length))


def valid_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]+$")


def title_of(content: Column, most: int = 60) -> Column:
    """The first line with content, its heading marks taken off, cut at a word within the bound."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    bare = F.transform(F.filter(lines, lambda x: ~x.startswith("<!--")), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    line = F.coalesce(F.get(F.filter(bare, lambda x: x != ""), F.lit(0)), F.lit("Untitled capture"))
    cut = F.substring(line, 1, most)
    space = F.char_length(F.substring_index(cut, " ", -1))
    at = F.lit(most) - space - 1
    short = F.when((cut.contains(" ")) & (at > most // 2), F.substr(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.char_length(line) <= most, line).otherwise(F.concat(short, F.lit("...")))


def format_tags(tags: Column) -> Column:
    return F.when(F.size(tags) == 0, "-").otherwise(F.array_join(tags, ","))


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def escape_bibtex(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([{}%$&#_])", r"\\$1")


def citation_key(url: Column, place: Column) -> Column:
    host = F.regexp_replace(F.split(F.regexp_replace(url, "^https?://", ""), "/")[0], "[.-]", "_")
    return F.concat(host, F.lit("_"), place.cast("string"))


def date_parts(text: Column) -> Column:
    """Year, month and day numbers, as far as given; null for anything else."""
    return F.when(text.rlike(r"^\d+(-\d+){0,2}$"), F.transform(F.split(text, "-"), lambda x: x.cast("int")))


def inverse(link_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in INVERSES.items() for x in kv))
    return F.coalesce(known[link_type], F.when(link_type.startswith("inverse-"), F.substring(link_type, 9, 1000)).otherwise(F.concat(F.lit("inverse-"), link_type)))


def link_cost(link_type: Column) -> Column:
    return F.when(link_type.isin(HALF_COST), 0.5).otherwise(1.0)


def edge_cost(link_type: Column, value: Column) -> Column:
    """Link cost, up to twice as much the less the target is worth."""
    return link_cost(link_type) * (1 + (100 - value) / 100.0)


def recency(at: Column, now: Column, numerator: float = 0.1, decay: float = 7.0) -> Column:
    age = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0, F.lit(0.0))
    return F.lit(numerator) / (1 + F.greatest(age, F.lit(0.0)) / decay)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: F.regexp_replace(x, r"\s", "") != ""))


def bucket(n: Column, edges: list[int], names: list[str]) -> Column:
    """names[i] for values below edges[i], the last name for the rest."""
    out = F.lit(names[-1])
    for e, name in zip(reversed(edges), reversed(names[:-1]), strict=True):
        out = F.when(n < e, name).otherwise(out)
    return out


# Limits below which a value belongs to the name.
DURATIONS = ([100, 500, 1000, 5000], ["less-than-100ms", "ms-100-to-500", "ms-500-to-1s", "s-1-to-5", "more-than-5s"])
RESULTS = ([1, 2, 6, 21, 101], ["zero", "one", "two-to-five", "six-to-twenty", "twenty-one-to-100", "more-than-100"])
NOTES = ([10, 101, 1001, 10001], ["less-than-10", "ten-to-100", "hundred-to-1000", "thousand-to-10000", "more-than-10000"])
SPACES = ([1, 2, 6, 21], ["zero", "one", "two-to-five", "six-to-twenty", "more-than-twenty"])


def decoded_value(value: Column) -> Column:
    return F.when(value.between(0, 100), value.cast("int"))


def base64(text: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n]", "")


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")
