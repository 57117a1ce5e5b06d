"""Personal data, and terms that disclose it, by information content.

Patterns find protected entities in every text. The corpus tells how strongly terms reveal them: with N documents, n(t) of
them holding term t, n(e) entity e and n(t, e) both, wherever they stand in the text,

    PMI(t, e) = log(N n(t, e) / (n(t) n(e)))   and   IC(e) = log(N / n(e)).

A term discloses an entity if PMI reaches ALPHA times IC (Sanchez and Batet, 2016, "C-sanitized"); every occurrence of it
in any document is then generalised. The hierarchy is the corpus's own: a prefix stands for all terms that begin with it,
whose counts add up, and a term becomes the longest of its prefixes, of LEVELS letters at most, that discloses none of the
entities, the empty one if need be. It is removed if PMI reaches IC itself, that is, if it never occurs without the entity.
Terms are whole runs of letters of any length outside the entities. Pairs count from SUPPORT different texts on, so that
copies of one text prove nothing; entities in fewer different texts are too rare for estimates of their own, so those of a
kind count as one entity. Only built-in functions are used. One pass over the texts finds entities, and the terms of texts
that have any; another counts all terms; a third finds the documents that hold disclosing terms, whose texts alone are
read again for the places. No text is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null, table, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ALPHA = 3, 0.9
#: Levels of the hierarchy: letters of its longest prefixes. Terms themselves may have any length.
LEVELS = 32
#: A noncharacter, which stands for every character of an entity with letters, and a whole term outside entities.
MASK = "\uffff"
TERM = r"(?<![\p{L}\x{FFFF}])\p{L}++(?!\x{FFFF})"
# The patterns as given, with runs made possessive and anchored to a run's start or the last match's end: they match the
# same spans, in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])?"
IP = rf"^(?=[0-9])(?:{_PART}\.){{3}}{_PART}$"
CHUNK = 256


def bind(value: Column, fn) -> Column:
    """fn(value), with the value worked out once although fn uses it in loops."""
    return F.transform(F.array(value), fn)[0]


def _running(lengths: Column) -> Column:
    """Running sums of a short array."""
    zero = F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("a"))
    return F.aggregate(lengths, zero, lambda z, x: F.struct((z["s"] + x).alias("s"), F.concat(z["a"], F.array(z["s"] + x)).alias("a")), lambda z: z["a"])


def running(lengths: Column) -> Column:
    """Running sums of an array of any length, by chunks, so that the cost doesn't grow with its square."""
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / CHUNK).cast("int") - 1), lambda b: _running(F.slice(lengths, b * CHUNK + 1, F.lit(CHUNK))))
    before = lambda c: bind(_running(F.transform(c, lambda x: F.element_at(x, -1))), lambda t: F.transform(c, lambda x, i: F.transform(x, lambda v: v + F.coalesce(F.get(t, i - 1), F.lit(0)))))
    return F.when(F.size(lengths) == 0, F.expr("cast(array() as array<int>)")).when(F.size(lengths) <= CHUNK, _running(lengths)).otherwise(F.flatten(bind(chunks, before)))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end (code points) and value."""
    p = F.lit(pattern)

    def build(x: Column) -> Column:
        ends = running(F.transform(x["m"], lambda m, i: F.char_length(x["g"][i]) + F.char_length(m)))
        fields = lambda e, m, i: [(e[i] - F.char_length(m)).alias("s"), e[i].alias("e"), m.alias("v")]
        return bind(ends, lambda e: F.transform(x["m"], lambda m, i: F.struct(*fields(e, m, i))))

    return bind(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, p, F.lit(0)).alias("m")), build)


def _luhn(value: Column) -> Column:
    def right(d: Column) -> Column:
        n = F.char_length(d)
        digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
        part = lambda i: F.when((n - i) % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
        return (n >= 16) & (n <= 19) & (F.when((n < 16) | (n > 19), 1).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda z, i: z + part(i))) % 10 == 0)

    return bind(F.regexp_replace(value, "[^0-9]", ""), right)


VALID = {"email": lambda v: F.lit(True), "ip": lambda v: v.rlike(IP), "card": _luhn, "phone": lambda v: F.char_length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)}
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}


def found(text: Column) -> Column:
    """All valid matches, by kind as listed, then start: structs of kind, s, e, v."""
    none = "cast(array() as array<struct<kind: string, s: int, e: int, v: string>>)"

    def of(kind: str) -> Column:
        hits = F.filter(located(text, PATTERNS[kind]), lambda x: VALID[kind](x["v"]))
        return F.when(HINTS[kind](text), F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))).otherwise(F.expr(none))

    return F.concat(*(of(k) for k in KINDS))


def masked(text: Column) -> Column:
    """The text with e-mails, the only entities that can hold letters, masked; every place stays where it is."""
    parts = F.struct(F.split(text, PATTERNS["email"], -1).alias("g"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("m"))
    joined = lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.repeat(F.lit(MASK), F.coalesce(F.char_length(F.get(x["m"], i)), F.lit(0))))), "")
    return F.when(HINTS["email"](text), bind(parts, joined)).otherwise(text)


def terms_of(text: Column) -> Column:
    """The different terms of a whole text."""
    runs = F.array_distinct(F.regexp_extract_all(masked(text), F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(runs, lambda t: F.lower(t)))


ENTITIES = "struct<spans: array<struct<kind: string, s: int, e: int, v: string>>, terms: array<string>>"


def digest(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def entities(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """keep as __k0.., digest of the text, and in __x the protected entities of each text and, if it has any, all its terms."""
    text = blank_if_null(F.col(f"`{text_col}`"))
    both = bind(found(text), lambda every: F.struct(every.alias("spans"), F.when(F.size(every) > 0, terms_of(text)).otherwise(F.expr("cast(array() as array<string>)")).alias("terms")))
    return docs.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)), digest(text).alias("__hash"), both.cast(ENTITIES).alias("__x"))


def disclosing(docs: DataFrame, texts: DataFrame, text_col: str, alpha: float = ALPHA) -> DataFrame:
    """(term, removed, general) for terms whose PMI with an entity reaches alpha times the entity's information content; general is the prefix that may stand for it.

    texts: __hash, copies, entities (structs of kind, entity) and terms of each different text that has entities.
    """
    total = float(docs.count())
    each = texts.select("__hash", "copies", F.explode("entities").alias("x")).select("__hash", "copies", "x.kind", "x.entity")
    key = F.when(F.count("*") >= SUPPORT, F.col("entity")).otherwise(F.col("kind"))
    keys = each.groupBy("kind", "entity").agg(key.alias("key")).drop("kind")
    held = written(each.join(keys, "entity").select("__hash", "copies", "key").distinct(), "pii-keys")
    of_key = held.groupBy("key").agg(F.sum("copies").alias("n_e"))
    pairs = held.join(texts.select("__hash", "terms"), "__hash").select("key", "copies", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("key", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT)
    pairs = written(pairs.join(of_key, "key").drop("texts"), "pii-pairs")
    counts = docs.select(F.explode(terms_of(blank_if_null(F.col(f"`{text_col}`")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    counts = written(counts, "pii-counts")
    scored = _scored(pairs.join(counts, "term"), total)
    told = written(scored.filter((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic"))), "pii-told")
    removed = told.groupBy("term").agg(F.max(F.col("pmi") >= F.col("ic") - 1e-9).alias("removed"))
    general = generalised(told.join(removed.filter("not removed"), "term", "left_semi"), pairs, counts, total, alpha)
    return removed.join(general, "term", "left").select("term", "removed", F.coalesce("general", F.lit("")).alias("general"))


def _scored(counted: DataFrame, total: float) -> DataFrame:
    """Adds pmi and ic to rows of n_te, n_t and n_e."""
    pmi, ic = F.log(F.lit(total) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e"))), F.log(F.lit(total) / F.col("n_e"))
    return counted.withColumn("pmi", pmi).withColumn("ic", ic)


def _prefixes(term: str = "term") -> Column:
    """The proper prefixes of a term in the hierarchy, a row each."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length(term) - 1, F.lit(LEVELS))), lambda n: F.substr(F.col(term), F.lit(1), n)))


def generalised(told: DataFrame, pairs: DataFrame, counts: DataFrame, total: float, alpha: float = ALPHA) -> DataFrame:
    """(term, general): the longest proper prefix of each told term that reaches alpha times the information content of none of the term's entities. told: key, term, n_e; pairs: key, term, n_te; counts: term, n_t."""
    wanted = written(told.filter(F.char_length("term") > 1).select("term", "key", "n_e", _prefixes().alias("prefix")), "pii-prefixes")
    long = lambda d: d.filter(F.char_length("term") > 1)
    own = wanted.select("prefix").distinct()
    n_t = counts.withColumn("prefix", F.col("term")).join(own, "prefix").select("prefix", "n_t").unionByName(long(counts).select(_prefixes().alias("prefix"), "n_t").join(own, "prefix"))
    n_t = n_t.groupBy("prefix").agg(F.sum("n_t").alias("n_t"))
    of = wanted.select("key", "prefix").distinct()
    n_te = pairs.withColumn("prefix", F.col("term")).join(of, ["key", "prefix"]).select("key", "prefix", "n_te").unionByName(long(pairs).select("key", _prefixes().alias("prefix"), "n_te").join(of, ["key", "prefix"]))
    n_te = n_te.groupBy("key", "prefix").agg(F.sum("n_te").alias("n_te"))
    scored = _scored(wanted.join(n_t, "prefix").join(n_te, ["key", "prefix"]), total)
    fine = scored.groupBy("term", "prefix").agg(F.bool_and(F.col("pmi") < alpha * F.col("ic")).alias("fine")).filter("fine")
    return fine.groupBy("term").agg(F.max_by("prefix", F.char_length("prefix")).alias("general"))


def places(docs: DataFrame, telling: DataFrame, text_col: str, row: Column) -> DataFrame:
    """__row and terms (structs s, e, removed, general) of every row that holds a telling term, one for rows with the same __row."""
    text = blank_if_null(F.col(f"`{text_col}`"))
    held = docs.select(row.alias("__row"), F.explode(terms_of(text)).alias("term")).join(telling, "term")
    held = written(held.groupBy("__row").agg(F.map_from_entries(F.collect_set(F.struct("term", F.struct("removed", "general").alias("how")))).alias("__telling")), "pii-held")
    hits = docs.select(row.alias("__row"), text.alias("__text")).join(held, "__row")
    looked = F.transform(located(masked(F.col("__text")), TERM), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), F.try_element_at("__telling", F.lower(y["v"])).alias("how")))
    terms = F.transform(F.filter(looked, lambda y: y["how"].isNotNull()), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["how"]["removed"].alias("removed"), y["how"]["general"].alias("general")))
    return hits.select("__row", terms.alias("terms")).dropDuplicates(["__row"])


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(value))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA) -> DataFrame:
    """Per row keep, __hash (a digest of its text), base (structs kind, s, e) and terms (structs s, e, removed, general), in code points.

    A null text counts as empty and has no spans. Rows with equal keep columns and texts get the same spans; an empty
    table gives an empty one; columns outside keep, whatever their names, play no part.
    """
    rows = written(entities(docs, text_col, keep), "pii-rows")
    keys = [f"__k{i}" for i in range(len(keep))]
    named = F.array_distinct(F.transform("one.spans", lambda x: F.struct(x["kind"].alias("kind"), _entity(x["kind"], x["v"]).alias("entity"))))
    texts = rows.filter(F.size("__x.spans") > 0).groupBy("__hash").agg(F.count("*").alias("copies"), F.first("__x").alias("one"))
    texts = written(texts.select("__hash", "copies", named.alias("entities"), "one.terms"), "pii-texts")
    telling = written(disclosing(docs, texts, text_col, alpha), "pii-telling")
    row = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), digest(blank_if_null(F.col(f"`{text_col}`"))).alias("h"))
    added = places(docs, telling, text_col, row)
    base = F.transform("__x.spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    slim = rows.select(*keys, "__hash", F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("__hash").alias("h")).alias("__row"), base.alias("base"))
    out = slim.join(added, "__row", "left")
    none = F.expr("cast(array() as array<struct<s: int, e: int, removed: boolean, general: string>>)")
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)), "__hash", "base", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """All rows of docs with entities replaced by their kind, and disclosing terms by a prefix that stands for many, as "abc*", or by nothing."""
    spans = scan(docs, text_col, (id_col,), alpha).dropDuplicates([id_col, "__hash"])
    cut = F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("to"))), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["removed"], "").otherwise(F.concat(x["general"], F.lit("*"))).alias("to"))))
    cuts = spans.select(F.col(id_col).alias("__id"), F.col("__hash").alias("__h"), F.array_sort(cut).alias("__cuts")).filter(F.size("__cuts") > 0)
    columns = docs.columns
    text = blank_if_null(F.col(f"`{text_col}`"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__doc"), F.col(f"`{id_col}`").alias("__own"), text.alias("__text"), digest(text).alias("__th"))
    joined = keyed.join(cuts, (F.col("__th") == F.col("__h")) & F.col("__own").eqNullSafe(F.col("__id")), "left")
    end = lambda z: z["at"]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    piece = lambda z, x: F.concat(F.substr(F.col("__text"), end(z) + 1, x["s"] - end(z)), x["to"])
    merge = lambda z, x: F.when(x["s"] < end(z), F.struct(F.greatest(end(z), x["e"]).alias("at"), z["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(z["out"], F.array(piece(z, x))).alias("out")))
    new = F.aggregate("__cuts", start, merge, lambda z: F.concat(F.array_join(z["out"], ""), F.substr(F.col("__text"), end(z) + 1)))
    pick = lambda c: F.when(F.col("__cuts").isNull(), F.col("__doc").getField(c)).otherwise(new) if c == text_col else F.col("__doc").getField(c)
    return joined.select(*(pick(c).alias(c) for c in columns))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that disclose it, in every document."""
    out = scan(table(spark, sf_dir, "documents"))
    spell = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = spell(F.col("base"))
    more = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.concat_ws(",", F.when(base != "", base), F.when(more != "", more))
    return out.select("doc_id", *(count(k) for k in KINDS), F.size("terms").cast("long").alias("n_terms"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), both.alias("spans"))
