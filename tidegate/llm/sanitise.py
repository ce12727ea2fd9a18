"""Personal data: patterns, and terms that give away what the patterns protect.

Patterns find protected entities: email addresses, IPv4 addresses, card numbers and phone
numbers.  A reader who knows the corpus can also be led to an entity by words that stand
in its documents and nearly nowhere else.  How far a term reveals an entity is its pointwise mutual
information with it, over documents, as a share of the entity's own information:

    disclosure(t, c) = log(n(t,c) * N / (n(t) * n(c))) / log(N / n(c))

It is 1 if the term occurs only with the entity, and 0 if it is independent of it.  n(t,c)
counts documents that hold both, the term outside of patterns; n(c) and n(t) documents that
hold the entity and the term, over the whole corpus of N documents.  A term seen with an
entity in SUPPORT documents or more is removed from a disclosure of REMOVE on, and
generalised to its kind from GENERALISE on, at every place in each text with the entity.

All is DataFrame and SQL functions: documents are scanned twice, once for the patterns,
once to count the words' documents.  Counts are pre-aggregated, and only entities seen in
SUPPORT documents are paired with words, so no task depends on how often an entity or a
term occurs.

Edge cases: null and empty texts have no spans.  Rows with equal doc_id are documents of
their own, and so are equal texts.  An empty table gives no rows; extra columns are left
out.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import few, stored

SUPPORT = 2
REMOVE = 0.9
GENERALISE = 0.6
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
WORD = r"[\p{L}\p{N}]+"

# The patterns match what plain leftmost ones do, in linear time and without recursion: an
# attempt starts only where an earlier one could not have, and nothing is given back that
# cannot help.  A card's number of digits is part of its pattern, as its runs are maximal.
_EMAIL_CHAR = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_EMAIL_CHAR}]))[{_EMAIL_CHAR}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap signs without which a text cannot match.
_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

SPAN = "struct<kind: string, rank: int, start: int, end: int, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def placed(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (start, end, value).

    Places follow from the lengths of the matches and of what lies between them.
    """
    between = F.split(text, pattern, -1)
    both = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    kind = "array<struct<start: int, end: int, value: string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        out = F.when(x["value"].isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(one)))
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(both, start, step, lambda held: held["out"])


def base_spans(text: Column) -> Column:
    """Valid matches of all kinds, by start, then kind in the order of KINDS."""
    return _in_order(F.concat(*[_spans_of(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    sign = text.contains("@") if kind == "email" else text.rlike(_SIGNS[kind])

    def named(x: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"),
            x["end"].alias("end"), x["value"].alias("value"),
        )

    spans = F.transform(F.filter(placed(text, PATTERNS[kind]), lambda x: valid(kind, x["value"])), named)
    return F.when(sign, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _in_order(spans: Column) -> Column:
    def before(a: Column, b: Column) -> Column:
        lower = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"]))
        return F.when(lower, -1).when((a["start"] == b["start"]) & (a["rank"] == b["rank"]), 0).otherwise(1)

    return F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(spans, before))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _entity(span: Column) -> Column:
    """An entity in one spelling: digits of numbers, letters in lower case."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _outside(text: Column, base: Column) -> Column:
    """Words that share no character with a span, in lower case, each once."""
    whole = F.concat(base, F.array(F.struct(
        F.lit(None).cast("string").alias("kind"), F.lit(0).alias("rank"), F.length(text).alias("start"),
        F.length(text).alias("end"), F.lit(None).cast("string").alias("value"),
    )))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        piece = F.substring(text, held["at"] + 1, F.greatest(x["start"] - held["at"], F.lit(0)))
        # A word that a span cuts is no word of its own on either side.
        cut = (held["at"] > 0) & F.substring(text, held["at"], F.lit(1)).rlike(WORD)
        piece = F.when(cut, F.regexp_replace(piece, rf"\A{WORD}", "")).otherwise(piece)
        cut = F.substring(text, x["start"] + 1, F.lit(1)).rlike(WORD) & (x["start"] < F.length(text))
        piece = F.when(cut, F.regexp_replace(piece, rf"(?<![\p{{L}}\p{{N}}]){WORD}\z", "")).otherwise(piece)
        return F.struct(
            F.greatest(held["at"], x["end"]).alias("at"), F.concat(held["out"], F.array(piece)).alias("out")
        )

    pieces = F.aggregate(whole, start, step, lambda held: held["out"])
    words = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0))))
    return F.array_distinct(F.transform(words, F.lower))


def _marked(text: Column, base: Column, terms: Column, remove: float) -> Column:
    """Spans of all places of the terms (a map to their disclosures) outside of other spans."""
    both = F.arrays_zip(
        F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["word"]), F.lit(0))
        term = F.lower(x["word"])
        disclosure = F.try_element_at(terms, term)
        removed = disclosure >= remove
        span = F.struct(
            F.when(removed, TERM_KINDS[0]).otherwise(TERM_KINDS[1]).alias("kind"),
            F.when(removed, len(KINDS)).otherwise(len(KINDS) + 1).alias("rank"),
            begin.alias("start"), end.alias("end"), term.alias("value"),
        )
        held_out = F.exists(base, lambda b: (b["start"] < end) & (begin < b["end"]))
        out = F.when(disclosure.isNotNull() & ~held_out, F.concat(held["out"], F.array(span))).otherwise(held["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(both, start, step, lambda held: held["out"])


def disclosing(
    found: DataFrame, texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame:
    """Disclosing terms of the texts: uid, terms (a map from each to its disclosure)."""
    n_all = F.lit(texts.count())
    holding = found.where("text is not null")
    own = holding.select("uid", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    n_entity = own.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    n_entity = stored(n_entity.where(F.col("n_c") < n_all), "entities")
    # Only these can be seen with a term often enough.
    chosen = own.join(few(n_entity), "entity").groupBy("uid").agg(F.collect_set("entity").alias("entities"))
    chosen = stored(chosen, "chosen")
    words = holding.join(few(chosen), "uid").select("uid", "entities", _outside(F.col("text"), F.col("base")).alias("words"))
    seen = words.select("uid", "words", F.explode("entities").alias("entity"))
    seen = stored(seen.select("uid", "entity", F.explode("words").alias("term")), "seen")
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_tc"))
    pairs = stored(pairs.where(F.col("n_tc") >= support), "pairs")
    each = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    n_term = texts.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    entity = F.log(n_all / F.col("n_c"))
    shared = F.log(F.col("n_tc") * n_all / (F.col("n_t") * F.col("n_c")))
    judged = (
        pairs.join(n_entity, "entity").join(n_term, "term")
        .select("entity", "term", (shared / entity).alias("disclosure"))
        .where(F.col("disclosure") >= generalise)
    )
    judged = stored(judged, "judged")
    told = seen.join(few(judged), ["entity", "term"]).groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure"))
    # Bounded by a text's words.
    return told.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))


def find_personal(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """One row per input row: uid, doc_id, base and spans (arrays of kind, rank, start, end, value)."""
    return _find(_rows(documents, text, doc_id), **settings)


def _rows(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    return documents.select(
        documents[doc_id].cast("bigint").alias("doc_id"), F.coalesce(documents[text], F.lit("")).alias("text")
    )


def _find(texts: DataFrame, remove: float = REMOVE, **settings) -> DataFrame:
    carried = [c for c in ("uid",) if c in texts.columns]
    rows = texts if carried else texts.withColumn("uid", F.monotonically_increasing_id())
    rows = rows.select("uid", "doc_id", "text", base_spans(F.col("text")).alias("base"))
    rows = rows.withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    found = stored(rows, "found")
    terms = stored(disclosing(found, texts, **settings), "terms")
    both = found.join(few(terms), "uid", "left")
    marked = F.concat("base", _marked(F.col("text"), F.col("base"), F.col("terms"), remove))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(_in_order(marked))
    return both.select("uid", "doc_id", "base", spans.alias("spans"))


def sanitised(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """doc_id, spans, and the text with spans replaced.

    Entities become their kind in square brackets.  A generalised term becomes [NUMBER],
    [NAME] (capitalised) or [WORD]; a removed one disappears.  Of overlapping spans the
    first counts, of those that start together the first by kind.
    """
    rows = stored(_rows(documents, text, doc_id).withColumn("uid", F.monotonically_increasing_id()), "texts")
    found = _find(rows, **settings).drop("doc_id")
    whole = rows.join(found, "uid")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, x: Column) -> Column:
        original = F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
        general = F.when(original.rlike("^[0-9]+$"), "[NUMBER]").when(original.rlike(r"^\p{Lu}"), "[NAME]")
        put = (
            F.when(x["kind"] == TERM_KINDS[0], "")
            .when(x["kind"] == TERM_KINDS[1], general.otherwise("[WORD]"))
            .otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        )
        before = F.substring(F.col("text"), held["at"] + 1, x["start"] - held["at"])
        taken = F.struct(x["end"].alias("at"), F.concat(held["out"], before, put).alias("out"))
        return F.when(x["start"] < held["at"], held).otherwise(taken)

    clean = F.aggregate(
        "spans",
        start,
        step,
        lambda held: F.concat(held["out"], F.substring(F.col("text"), held["at"] + 1, F.length("text"))),
    )
    return whole.select("doc_id", "spans", clean.alias("text"))
