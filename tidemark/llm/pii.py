"""Personal data and the terms that give it away, by DataFrame functions alone.

Four kinds of personal data are found by patterns and checks.  Then the corpus says how strongly terms reveal the
entities found.  A term t that stands anywhere in a text with an entity e tells log(p(e | t) / p(e)) of the entity's
own information -log p(e); what stays unknown are -log p(e | t) bits.  p(e | t) is the share of the documents with t
that have e, counted over all documents, times n / (n + prior) for the n different texts that show both: few
texts, and copies of one text, say little.  A term that leaves at most ``disclose`` bits, and tells ``share`` of the
entity's information or more, is generalised wherever it stands in a text with the entity; one that leaves at most
``remove`` bits is removed.  The thresholds are bits, so they mean the same at every number of documents.

By these thresholds a term may not be much more frequent than the entity, so only such are paired.  Entities of the same documents count as one class, as do terms, so that long lists of them that
occur together make one pair.

Cases: a null or empty text has no spans; spans depend on the text alone, so a null doc_id and rows that repeat are
rows like others, and texts that differ under one doc_id are judged apart; spans of different kinds may overlap and
all stay, terms that touch base spans are left out; very long texts are searched whole, in time in proportion to
their length; an empty table gives an empty table; only ``doc_id`` and ``text`` are read, so other columns and
their names don't matter.

The patterns are possessive where nothing behind could need what they hold, so that no match costs stack or time
beyond its length, and start only where a run of their characters starts, which finds the same leftmost matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A term is a whole run of at least so many letters.
LETTERS = 3
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
#: Neighbours whose sums are taken in one step, and code points of a text that are rewritten in one step.
BLOCK, PIECE = 32, 1024


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once; an expression named in a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _sums_before(steps: Column, levels: int = 3) -> Column:
    """For each element of an array that isn't empty, the sum of those before it, by sums of blocks and of blocks of blocks."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)
    within = lambda part, before: F.transform(part, lambda _, i: before + total(F.slice(part, F.lit(1), i)))
    if not levels:
        return _let(steps, lambda a: within(a, F.lit(0).cast("bigint")))

    def blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, _sums_before(F.transform(p, total), levels - 1), within)))

    return _let(steps, blocks)


def _places(text: Column, pattern: str) -> Column:
    """All leftmost matches as an array of (start, end, value), in code points, from the lengths of what lies between; null if there are none."""

    def places(values: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), lambda g: F.length(g).cast("bigint"))
        place = lambda v, start: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))
        starts = _let(gaps, lambda g: F.zip_with(g, _sums_before(F.zip_with(g, values, lambda x, v: x + F.length(v))), lambda x, before: x + before))
        return F.when(F.size(values) > 0, F.zip_with(values, starts, place))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _fits(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _may(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))


def _found(kind: str, text: Column) -> Column:
    rank = KINDS.index(kind)
    places = F.filter(F.when(_may(kind, text), _places(text, PATTERNS[kind])), lambda p: _fits(kind, p["value"]))
    whole = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["end"].alias("end"), F.lower(p["value"]).alias("value")))
    return F.coalesce(whole, F.array().cast(SPANS))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, base: all base spans with values, by start and kind; and the text where there are any, so that no others move."""
    text = F.coalesce("text", F.lit(""))
    spans = F.array_sort(F.concat(*(_found(k, text) for k in KINDS)))
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), spans.alias("base"), "text").withColumn("text", F.when(F.size("base") > 0, F.col("text")))


def _own(found: DataFrame) -> DataFrame:
    """hash, copies, base and text of the different texts with base spans."""
    return found.where(F.size("base") > 0).groupBy("hash").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("text").alias("text"))


def _words(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS), F.lower))


def _marks(weight: Column) -> list[Column]:
    """Sums that tell sets of documents apart: of two hashes of 30 bits, so that 2**33 documents don't overflow."""
    part = lambda seed: F.sum(weight * F.xxhash64("hash", F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)))
    return [part(1).alias("x"), part(2).alias("y")]


def disclosures(docs: DataFrame, own: DataFrame, disclose: float, remove: float, share: float, prior: float) -> DataFrame:
    """hash of a text, word of it that discloses an entity of the text, and whether the word is to be removed."""
    seen = own.select("hash", "copies", F.inline("base")).select("hash", "copies", "kind", "value").distinct()
    least = 2.0**-disclose
    fewest = math.ceil(prior * least / (1 - least))
    entities = seen.groupBy("kind", "value").agg(F.sum("copies").alias("n"), F.count("*").alias("texts"), *_marks(F.col("copies"))).where(F.col("texts") >= fewest)
    held = seen.join(entities, ["kind", "value"]).select("hash", "copies", F.struct("n", "x", "y").alias("e")).distinct()
    held = written(held, "held")
    if not held.limit(1).count():
        return held.select("hash", F.lit("").alias("word"), F.lit(False).alias("gone"))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("hash"), _words(F.col("text")).alias("words"))
    words = texts.select("hash", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *_marks(F.lit(1)))
    # Of each text with such an entity, the words that aren't much more frequent than its most frequent entity.
    most = held.groupBy("hash").agg(F.max("copies").alias("copies"), F.max("e.n").alias("most"))
    stands = own.select("hash", "text").join(most, "hash").select("hash", "copies", "most", F.explode(_words(F.col("text"))).alias("word")).join(words, "word")
    stands = written(stands.where((F.col("n") * least <= F.col("most")) & (F.col("n") >= fewest)).select("hash", "copies", "word", F.struct("n", "x", "y").alias("w")), "stands")
    sets = stands.select("hash", "copies", "w").distinct()
    both = sets.join(held.drop("copies"), "hash").where(F.col("w.n") * least <= F.col("e.n"))
    both = both.groupBy("e", "w").agg(F.sum("copies").alias("n"), F.count("*").alias("texts"))
    given = F.col("n") / F.col("w.n") * F.col("texts") / (F.col("texts") + prior)
    general = F.col("e.n") / F.lit(float(max(docs.count(), 1)))
    left = -F.log2(given)
    told = both.withColumn("left", left).where((F.col("left") <= disclose) & (-F.log2(general) - F.col("left") >= -share * F.log2(general)) & (general < 1))
    told = written(told.select("e", "w", "left"), "told")
    due = held.join(told, "e").groupBy("hash", "w").agg(F.min("left").alias("left"))
    return stands.join(due, ["hash", "w"]).select("hash", "word", (F.col("left") <= remove).alias("gone"))


def _terms(own: DataFrame, due: DataFrame) -> DataFrame:
    """hash and terms: spans of the words that are due in each text and touch no base span."""
    texts = own.join(due.select("hash").distinct(), "hash")
    words = texts.select("hash", F.inline(_places(F.col("text"), rf"\p{{L}}{{{LETTERS},}}+"))).withColumn("word", F.lower("value"))
    words = words.join(due, ["hash", "word"]).select("hash", "start", "end", F.when(F.col("gone"), "").otherwise(f"[{TERM.upper()}]").alias("by"))
    base = texts.select("hash", F.inline("base")).select("hash", "start", "end", F.lit(None).cast("string").alias("by"))
    both = words.unionByName(base)
    up, down = (Window.partitionBy("hash").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("start").asc(), F.col("start").desc()))
    both = both.withColumn("before", F.max(F.when(F.col("by").isNull(), F.col("end"))).over(up)).withColumn("behind", F.min(F.when(F.col("by").isNull(), F.col("start"))).over(down))
    clear = both.where(F.col("by").isNotNull() & F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("behind") >= F.col("end"), F.lit(True)))
    term = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), "end", F.col("by").alias("value"))
    return clear.groupBy("hash").agg(F.sort_array(F.collect_list(term)).alias("terms"))


def spans(docs: DataFrame, disclose: float = 0.6, remove: float = 0.08, share: float = 0.75, prior: float = 0.5) -> DataFrame:
    """doc_id, hash, base, text where there are base spans, and terms: arrays of spans; a term's value says whether it is to be removed ("") or generalised ("[TERM]")."""
    docs = docs.select("doc_id", "text")
    found = written(find(docs), "found")
    own = written(_own(found), "own")
    due = written(disclosures(docs, own, disclose, remove, share, prior), "due")
    if not due.limit(1).count():
        return found.withColumn("terms", F.array().cast(SPANS))
    return found.join(_terms(own, due), "hash", "left").withColumn("terms", F.coalesce("terms", F.array().cast(SPANS)))


def _listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, all spans as kind:start:end by start, then kind."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.array_sort(F.concat("base", "terms"))
    return spans(docs).select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def _rewritten(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """hash and text, as ``texts`` has them, without the spans of ``marks`` (hash, start, end, by), each replaced by its ``by``.

    Of spans that overlap, the first is replaced, and what the next adds behind it goes with it.  Texts are rewritten
    in pieces, so that no step copies more than a piece.
    """
    before = F.max("end").over(Window.partitionBy("hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    cuts = marks.withColumn("before", F.coalesce(before, F.lit(0).cast("bigint")))
    cuts = cuts.select("hash", F.greatest("start", "before").alias("start"), "end", F.when(F.col("start") >= F.col("before"), F.col("by")).otherwise("").alias("by")).where("start < end")
    last = F.floor((F.col("end") - 1) / PIECE)
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / PIECE), last)))
    base = F.col("k") * PIECE
    cuts = cuts.select("hash", "k", F.struct((F.greatest(F.col("start"), base) - base).alias("start"), (F.least(F.col("end"), base + PIECE) - base).alias("end"), F.when(F.col("start") >= base, F.col("by")).otherwise("").alias("by")).alias("cut"))
    cuts = cuts.groupBy("hash", "k").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    pieces = texts.select("hash", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("k", "piece")).withColumn("k", F.col("k").cast("bigint"))
    text = F.col("piece")

    def step(a: Column, c: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (c["start"] - a["at"]).cast("int")), c["by"])
        return F.struct(c["end"].alias("at"), fresh.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("cuts", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(PIECE))))
    new = pieces.join(cuts, ["hash", "k"], "left").select("hash", F.struct("k", F.coalesce(done, text).alias("piece")).alias("piece"))
    return new.groupBy("hash").agg(F.sort_array(F.collect_list("piece")).alias("pieces")).select("hash", F.array_join(F.col("pieces.piece"), "").alias("text"))


def sanitise(docs: DataFrame, **parameters: float) -> DataFrame:
    """docs, all columns, with base spans in ``text`` replaced by their kind in brackets and disclosing terms generalised or removed."""
    found = written(spans(docs, **parameters), "spans")
    named = F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("by"))))
    own = written(found.where(F.size("base") > 0).groupBy("hash").agg(F.first(named).alias("marks"), F.first("text").alias("text")), "own")
    new = written(_rewritten(own.select("hash", "text"), own.select("hash", F.inline("marks"))), "texts").select(F.col("hash").alias("key"), F.col("text").alias("new"))
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))
    joined = rows.join(new, F.xxhash64("row.text") == F.col("key"), "left")
    return joined.select(*(F.coalesce("new", "row.text").alias("text") if n == "text" else F.col(f"row.`{n}`") for n in names))
