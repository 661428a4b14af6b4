"""Personal data and the terms that reveal it.

Base spans are what fixed patterns and checks find: emails, IPv4 addresses, card
numbers, phone numbers. Their values are the protected entities. How strongly a term
reveals an entity is estimated from co-occurrence in the whole corpus: with
n(t, e) the occurrences of term t within ``WINDOW`` words of a mention of e,
n(t) all its occurrences and N those of all terms, those within emails left out,

    disclosure = PMI(t; e) / IC(e) = 1 + log2(n(t, e) / n(t)) / IC(e)

where IC(e) = -log2(share of all terms that stand near e). It is 1 if t occurs near
e alone and 0 if it says nothing about e. Every occurrence, in any text and outside the base
spans, of a term with a disclosure of ``DISCLOSES`` or more for some entity becomes a span of kind ``term``.
The evidence must come from ``SUPPORT`` different contexts, the words on both sides of
the mention, so copies of one passage are no evidence. Function words, which stand near anything,
need ``SUPPORT`` different left and right neighbours as well.
Sanitised texts have base spans and such terms replaced by their kind; terms that
reveal (nearly) everything (``REMOVES``) are removed.

A mention gives rows for the words near it only, counts are combined on the map side, the
occurrences that a table of ``SLOTS`` marks can rule out are not shuffled, and all of it is DataFrame expressions. Null text counts as empty: no spans. Rows
with equal doc_id and text get equal spans. An empty table gives an empty result.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import row_key, stored
from fieldtally.llm.html_text import STOP_WORDS
from fieldtally.operators.columns import compute_once

WINDOW, SUPPORT, DISCLOSES, REMOVES = 8, 3, 0.9, 0.99
SLOTS = 1 << 19  # marks of disclosing terms that tasks get, a byte each
STEP = 256  # words between places counted from the start of a text

#: Kinds in order. The patterns are written without backtracking and start where a run starts or the last match ended,
#: so they take linear time; they find what the plain patterns find.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"\p{L}[\p{L}\p{M}'’]*+"
#: Emails before terms, as the words within an email are protected with it and are no terms.
TOKEN = rf"{PATTERNS['email']}|{TERM}"

TERMS = "array<struct<start:int,end:int,removed:boolean>>"
PLAIN = "array<struct<start:int,kind:int,end:int,removed:boolean>>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 1, twice).otherwise(digit)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return F.forall(
            F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
        )
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def context(piece: Column) -> Column:
    """The first ``WINDOW`` words of a text and the white space around them."""
    return F.regexp_extract(piece, rf"^(?:\s*+\S++){{0,{WINDOW}}}", 0)


def total(numbers: str, first: Column, count: Column) -> Column:
    """The sum of some of the numbers of an array column."""
    return F.aggregate(F.slice(numbers, first + 1, count), F.lit(0), lambda a, n: a + n)


def with_places(rows: DataFrame, lengths: dict[str, Column]) -> DataFrame:
    """The rows with, of each array of lengths, a column of that name and, for ``end_of``, of its sums in steps of STEP and what
    comes before each step: so a place takes few additions, however long the array is."""
    rows = compute_once(rows, lengths)

    def sums(c: str) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(c) - 1) / STEP).cast("int"))
        return F.transform(steps, lambda s: total(c, s * STEP, F.lit(STEP)))

    def heads(c: str) -> Column:
        return F.transform(f"{c}_sums", lambda _, s: total(f"{c}_sums", F.lit(0), s))

    rows = compute_once(rows, {f"{c}_sums": sums(c) for c in lengths})
    return compute_once(rows, {f"{c}_heads": heads(c) for c in lengths})


def end_of(lengths: str, i: Column) -> Column:
    """The sum of the lengths up to the i-th (from 0)."""
    step = F.floor(i / STEP).cast("int")
    return F.get(f"{lengths}_heads", step) + total(lengths, step * STEP, i % STEP + 1)


def with_base(rows: DataFrame) -> DataFrame:
    """The rows with ``base``: the base spans of ``text``, by start and kind. What does not pass its check gets no span and no context,
    and all places come from sums in steps, so a text of numbers takes time in proportion."""
    text = F.coalesce("text", F.lit(""))
    present = {"email": text.contains("@"), "phone": text.contains("+")}
    found = {}
    for k, pattern in PATTERNS.items():
        shown = present.get(k, text.rlike("[0-9]"))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found[f"{k}_values"] = F.when(shown, values).otherwise(F.array().cast("array<string>"))
        found[f"{k}_between"] = F.when(shown, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    rows = compute_once(rows, found)

    def passing(k: str) -> Column:
        checked = F.transform(f"{k}_values", lambda v, i: F.struct(i.alias("i"), valid(k, v).alias("good")))
        return F.transform(F.filter(checked, lambda c: c["good"]), lambda c: c["i"])

    def lengths_of(k: str) -> Column:
        both = F.transform(f"{k}_values", lambda v, i: F.length(F.get(f"{k}_between", i)) + F.length(v))
        return F.when(F.size(f"{k}_good") > 0, both).otherwise(F.array(F.lit(0)))

    good = {f"{k}_good": passing(k) for k in KINDS}
    rows = compute_once(rows, good)
    lengths = {f"{k}_lengths": lengths_of(k) for k in KINDS}
    rows = with_places(rows, lengths)

    def span(k: str, i: Column) -> Column:
        value, end = F.get(f"{k}_values", i), end_of(f"{k}_lengths", i)
        return F.struct(
            (end - F.length(value)).alias("start"),
            F.lit(KINDS.index(k)).alias("kind"),
            end.alias("end"),
            value.alias("value"),
            F.reverse(context(F.reverse(F.get(f"{k}_between", i)))).alias("before"),
            context(F.get(f"{k}_between", i + 1)).alias("after"),
        )

    def spans_of(k: str) -> Column:
        return F.transform(f"{k}_good", lambda i: span(k, i))

    made = [*found, *good, *(c + e for c in lengths for e in ("", "_sums", "_heads"))]
    return compute_once(rows, {"base": F.array_sort(F.concat(*[spans_of(k) for k in KINDS]))}).drop(*made)


def in_blocks(base: Column) -> Column:
    """Spans in order of start, STEP at a time, with where each block begins and ends."""
    numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size(base) / STEP).cast("int")), lambda b: b * STEP < F.size(base))

    def block(b: Column) -> Column:
        spans = F.transform(F.slice(base, b * STEP + 1, F.lit(STEP)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        ends = F.array_max(F.transform(F.slice(base, b * STEP + 1, F.lit(STEP)), lambda s: s["end"]))
        return F.struct(F.get(base, b * STEP)["start"].alias("low"), ends.alias("high"), spans.alias("spans"))

    return F.transform(numbers, block)


def overlapping(blocks: Column | str, start: Column, end: Column) -> Column:
    """The spans that overlap a range, looked for in the blocks that do."""
    reached = F.filter(blocks, lambda b: (b["low"] < end) & (b["high"] > start))
    return F.flatten(F.transform(reached, lambda b: F.filter(b["spans"], lambda s: (s["start"] < end) & (s["end"] > start))))


def entity(span: Column) -> Column:
    value = F.when(span["kind"] >= 2, digits_of(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], value)


def base(documents: DataFrame) -> DataFrame:
    """doc_id, key, and ``base``: the base spans with the words around them, by start and kind. Written once."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("key"), "text")
    return stored(with_base(rows).select("doc_id", "key", "base"), "base-spans")


def nearby(found: DataFrame) -> DataFrame:
    """A row for each term near an entity: key, entity, term, common (a function word), start, end, and, of one mention that
    it is near, the context and its neighbours left and right."""
    held = compute_once(found.select("key", "base").filter(F.size("base") > 0), {"blocks": in_blocks(F.col("base"))})
    near = lambda m: overlapping("blocks", m["start"] - F.length(m["before"]), m["end"] + F.length(m["after"]))
    mentions = F.transform("base", lambda m: F.struct(m.alias("m"), near(m).alias("spans")))
    mention = held.select("key", F.explode(mentions).alias("both")).select("key", "both.m", "both.spans")
    words = F.regexp_replace(F.lower(F.concat_ws(" ", "m.before", "m.after")), r"[^\p{L}\p{M}]+", " ")
    sides = F.array(
        F.struct((F.col("m.start") - F.length("m.before")).alias("at"), F.col("m.before").alias("words")),
        F.struct(F.col("m.end").alias("at"), F.col("m.after").alias("words")),
    )
    side = mention.select("key", "spans", entity(F.col("m")).alias("entity"), F.xxhash64(words).alias("context"), F.explode(sides).alias("s"))
    terms = side.select(
        "key", "spans", "entity", "context", F.col("s.at").alias("at"),
        F.regexp_extract_all("s.words", F.lit(TERM), F.lit(0)).alias("terms"),
        F.split("s.words", TERM, -1).alias("gaps"),
    )
    exploded = terms.select("*", F.posexplode("terms").alias("i", "word"))
    # at most 2 * WINDOW words a side, short sums
    length = F.aggregate(
        F.slice("gaps", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, g: a + F.length(g)
    ) + F.aggregate(F.slice("terms", F.lit(1), F.col("i")), F.lit(0), lambda a, t: a + F.length(t))
    start = (F.col("at") + length).alias("start")
    rows = exploded.select(
        "key", "spans", "entity", "context", F.xxhash64(F.lower("word")).alias("term"), start,
        F.lower("word").isin(*sorted(STOP_WORDS)).alias("common"),
        (F.col("at") + length + F.length("word")).alias("end"),
        F.xxhash64(F.lower(F.get("terms", F.col("i") - 1))).alias("left"),
        F.xxhash64(F.lower(F.get("terms", F.col("i") + 1))).alias("right"),
    )
    outside = ~F.exists("spans", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    seen = F.min(F.struct("context", "left", "right")).alias("seen")
    rows = rows.filter(outside).groupBy("key", "entity", "term", "common", "start", "end").agg(seen)
    return rows.select("key", "entity", "term", "common", "start", "end", "seen.*")


def term_counts(documents: DataFrame) -> DataFrame:
    """term, n: occurrences of every term in all texts outside emails, combined on the map side."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("word"))
    return words.filter(~F.col("word").contains("@")).groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"))


def disclosing(documents: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs over the threshold."""
    counts = stored(term_counts(documents), "term-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = near.groupBy("entity", "term", "common", "context", "left", "right").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term", "common").agg(
        F.sum("n").alias("n_both"),
        *[F.countDistinct(c).alias(f"{c}s") for c in ("context", "left", "right")],
    )
    pairs = pairs.filter((F.col("contexts") >= SUPPORT) & (~F.col("common") | (F.least("lefts", "rights") >= SUPPORT)))
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity"))
    risk = pairs.join(counts, "term").join(entities, "entity")
    information = F.log2(F.greatest(F.lit(float(total)) / F.col("n_entity"), F.lit(2.0)))
    disclosure = 1 + F.log2(F.least(F.col("n_both") / F.col("n"), F.lit(1.0))) / information
    return risk.select("entity", "term", disclosure.alias("disclosure")).filter(F.col("disclosure") >= DISCLOSES)


def slots_of(terms: DataFrame) -> bytes | None:
    """A mark for each hash slot that holds one of the terms: SLOTS bytes, however many terms there are. None without terms."""
    slot = F.pmod("term", F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = terms.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    marks = np.zeros(SLOTS // 64, "<i8")
    for at, bits in words:
        marks[at] = bits
    return np.unpackbits(marks.view(np.uint8), bitorder="little").tobytes() if words else None


def occurrences(documents: DataFrame, marked: Callable[[Column], Column]) -> DataFrame:
    """key, term, start, end of the terms outside emails whose hash is marked, in all texts."""
    text = F.col("text")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    rows = compute_once(documents.select(row_key(documents).alias("key"), "text").filter("text is not null"), {"tokens": tokens})
    hits = F.transform(
        "tokens",
        lambda t, i: F.struct(
            i.alias("i"), F.length(t).alias("size"), F.xxhash64(F.lower(t)).alias("term"), t.contains("@").alias("email")
        ),
    )
    rows = compute_once(rows, {"hits": F.filter(hits, lambda h: marked(h["term"]) & ~h["email"])}).filter(F.size("hits") > 0)
    rows = compute_once(rows, {"gaps": F.split(text, TOKEN, -1)})
    lengths = F.transform("tokens", lambda t, i: F.length(F.get("gaps", i)) + F.length(t))
    rows = with_places(rows.drop("text"), {"lengths": lengths}).drop("tokens", "gaps")

    def placed(hit: Column) -> Column:
        end = end_of("lengths", hit["i"])
        return F.struct((end - hit["size"]).alias("start"), end.alias("end"), hit["term"].alias("term"))

    return compute_once(rows, {"places": F.transform("hits", placed)}).select("key", F.inline("places"))


def term_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """key and ``terms``: spans (start, end, removed) of the disclosing terms of each text that has any."""
    near = stored(nearby(found), "near-terms")
    risky = disclosing(documents, near).groupBy("term").agg((F.max("disclosure") >= REMOVES).alias("removed"))
    risky = stored(risky, "disclosing-terms")
    slots = slots_of(risky)
    if slots is None:
        return documents.sparkSession.createDataFrame([], f"key string, terms {TERMS}")
    table = F.lit(bytearray(slots))
    marked = lambda term: F.substring(table, F.pmod(term, F.lit(SLOTS)).cast("int") + 1, 1) == F.lit(bytearray(b"\1"))
    hits = occurrences(documents, marked).join(risky, "term")
    # rows equal in doc_id and text share a key, and their spans count once
    return hits.groupBy("key").agg(F.collect_set(F.struct("start", "end", "removed")).alias("terms"))


def with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``found`` with ``terms``: spans of their disclosing terms that overlap no base span."""
    joined = found.join(terms, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS)))
    joined = compute_once(joined, {"blocks": F.when(F.size("terms") > 0, in_blocks(F.col("base")))})
    outside = F.filter("terms", lambda t: F.size(overlapping("blocks", t["start"], t["end"])) == 0)
    return joined.withColumn("terms", F.when(F.size("terms") > 0, outside).otherwise(F.col("terms"))).drop("blocks")


def all_spans(documents: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``terms`` of each row."""
    found = base(documents)
    return with_terms(found, term_spans(documents, found)).select("doc_id", "base", "terms")


def written(spans: Column) -> Column:
    """kind:start:end of spans with (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def plain(spans: Column, terms: Column) -> Column:
    """Spans (start, kind, end, removed) of both kinds in order."""
    first = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("removed"))
    )
    last = F.transform(
        terms,
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), s["removed"].alias("removed")),
    )
    return F.array_sort(F.concat(first, last))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, all spans."""
    rows = all_spans(documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(plain(F.col("base"), F.col("terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


def replaced(rows: DataFrame) -> DataFrame:
    """The rows with ``written``: ``text`` with each of ``spans`` replaced by its kind in brackets; of overlapping spans the first to
    start counts. Spans are taken STEP at a time, each with its own part of the text."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "term"]])
    numbers = lambda c: F.filter(F.sequence(F.lit(0), F.floor(F.size(c) / STEP).cast("int")), lambda b: b * STEP < F.size(c))

    def apart(kept: Column, s: Column) -> Column:
        return F.when(s["start"] >= kept["at"], F.struct(s["end"].alias("at"), F.concat(kept["spans"], F.array(s)).alias("spans"))).otherwise(kept)

    def block_apart(kept: Column, b: Column) -> Column:
        own = F.aggregate(F.slice("spans", b * STEP + 1, F.lit(STEP)), F.struct(kept["at"].alias("at"), F.array().cast(PLAIN).alias("spans")), apart)
        both = lambda o: F.struct(o["at"].alias("at"), F.concat(kept["parts"], F.array(o["spans"])).alias("parts"))
        return F.get(F.transform(F.array(own), both), F.lit(0))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLAIN}>").alias("parts"))
    kept = F.aggregate(numbers("spans"), start, block_apart, lambda k: F.flatten(k["parts"]))
    rows = compute_once(rows, {"_kept": kept})

    def part(b: Column) -> Column:
        spans = F.slice("_kept", b * STEP + 1, F.lit(STEP))
        begin = F.when(b > 0, F.get("_kept", b * STEP - 1)["end"]).otherwise(0)
        end = F.get("_kept", F.least(b * STEP + STEP, F.size("_kept")) - 1)["end"]
        return F.struct(begin.alias("begin"), spans.alias("spans"), F.substring("text", begin + 1, end - begin).alias("text"))

    rows = compute_once(rows, {"_parts": F.transform(numbers("_kept"), part)})

    def with_names(p: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(p["spans"], i - 1)["end"]).otherwise(p["begin"])
            mark = F.when(s["removed"], "").otherwise(F.get(names, s["kind"]))
            return F.concat(F.substring(p["text"], before - p["begin"] + 1, s["start"] - before), mark)

        return F.array_join(F.transform(p["spans"], one), "")

    rest = F.substring("text", F.element_at("_kept", -1)["end"] + 1, F.length("text"))
    written = F.concat(F.array_join(F.transform("_parts", with_names), ""), rest)
    return compute_once(rows, {"written": F.when(F.size("_kept") > 0, written).otherwise(F.col("text"))}).drop("_kept", "_parts")


def sanitised(documents: DataFrame) -> DataFrame:
    """The rows with personal data and disclosing terms replaced in ``text``; other columns as they are."""
    found = base(documents)
    spans = with_terms(found.select("key", "base"), term_spans(documents, found))
    spans = spans.select("key", plain(F.col("base"), F.col("terms")).alias("spans")).filter(F.size("spans") > 0)
    spans = spans.dropDuplicates(["key"])
    # columns by number, so that none clashes with those made here
    own = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(documents.columns)]
    joined = documents.select(row_key(documents).alias("key"), *own).join(spans, "key", "left")
    text = F.col(f"_{documents.columns.index('text')}").alias("text")
    joined = replaced(joined.select("*", text).withColumn("spans", F.coalesce("spans", F.array().cast(PLAIN))))
    return joined.select(*[(F.col("written") if c == "text" else F.col(f"_{i}")).alias(c) for i, c in enumerate(documents.columns)])
