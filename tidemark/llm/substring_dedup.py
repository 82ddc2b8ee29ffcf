"""Removal of word windows that occurred before, by a log-structured index of fingerprints.

A window is ``WINDOW`` consecutive words.  Its anchor is the run of ``GRAM`` words in it with the smallest hash,
so equal windows have equal anchors at equal places.  The neighbouring windows of a document that share an anchor
make one entry: the anchor's fingerprint, a fingerprint of all words of these windows, and where they are.  Entries
of a batch of documents form a sorted immutable run.  A new batch is merged with the runs of earlier ones:

* an entry that equals an earlier one repeats it in all its windows;
* an anchor with entries that differ is verified: the windows of the first entry of each kind are hashed one by
  one from the texts, and each that isn't the first of its kind is a repeat;
* an anchor that occurs once has no repeats.

Runs are compacted into one when there are ``fanout`` of them.  Repeats within a slice of rows are settled before
the shuffle, so that a passage that many documents share sends one entry for each slice.

Cases: a null or empty text has no words; fewer than ``WINDOW`` words have no window; ties in place are broken by
doc_id, then by start; rows that repeat with their doc_id count as one document; different texts under one doc_id
are parts of one document, in order of their hashes, without windows across them; rows with a null doc_id stay
whole and are no history; very long texts are one document like others; an empty table gives an empty table; only
``doc_id`` and ``text`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, written
from tidemark.llm.textutil import arrow_map, mix64, releasing, split_words, word_hashes

WINDOW, GRAM = 20, 7
#: Ranges of doc_id that are added one after the other, and runs that are compacted into one.
BATCHES, FANOUT = 3, 2
BASE = 0x9E3779B97F4A7C15
ENTRY = "doc long, at long, fp long, ctx long, repeat boolean"
#: ``at`` holds, from the lowest bits up, the number of windows after the first, the first's start, and the rank of the text among those of its doc_id.
BITS, STARTS = 8, 40


class Hashes:
    """Fingerprints of any run of neighbours in an array of word hashes, by sums of powers modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int = BASE) -> None:
        n = len(hashes)
        with np.errstate(over="ignore"):
            inverse = pow(base, -1, 1 << 64)
            power = np.full(n + 1, base, np.uint64)
            back = np.full(n + 1, inverse, np.uint64)
            power[0] = back[0] = 1
            np.multiply.accumulate(power, out=power)
            self.back = np.multiply.accumulate(back)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value among each ``width`` neighbours."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def _counted(at: np.ndarray | int) -> np.ndarray | int:
    """Number of windows after the first."""
    return at & ((1 << BITS) - 1)


def _start(at: np.ndarray | int) -> np.ndarray | int:
    return at >> BITS & ((1 << STARTS) - 1)


def _rank(at: np.ndarray | int) -> np.ndarray | int:
    return at >> (BITS + STARTS)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_flags(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in ``order``: whether all keys equal those of the row before."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        k = k[order]
        same[1:] &= k[1:] == k[:-1]
    return same


def _entries(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, codes, offsets = split_words(batch.column(1))
    hashes = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    n = len(hashes)
    doc = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), np.diff(offsets))
    first = np.repeat(offsets[:-1], np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    if n < WINDOW:
        starts = np.zeros(0, np.int64)
    else:
        starts = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= last[: n - WINDOW + 1])
    if not len(starts):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4 + [pa.array([], pa.bool_())], ["doc", "at", "fp", "ctx", "repeat"])
    sums = Hashes(hashes)
    every = np.arange(n - GRAM + 1)
    grams = sums.of(every, every + GRAM)
    anchor = _leftmost_least(grams, WINDOW - GRAM + 1)[starts]
    cut = np.ones(len(starts), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    a = starts[cut]
    b = starts[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(starts) - 1]))]
    p = anchor[cut]
    fp = grams[p]
    with np.errstate(over="ignore"):
        ctx = mix64(sums.of(a, b + WINDOW) + mix64(((p - a) * 64 + (b - a)).astype(np.uint64)))
    rank = np.repeat(batch.column(2).to_numpy(), np.diff(offsets))
    own, at = doc[a], (rank[a] << (BITS + STARTS)) | ((a - first[a]) << BITS) | (b - a)
    order = np.lexsort((at, own, ctx, fp))
    repeat = np.zeros(len(a), bool)
    same = _first_flags(order, fp, ctx)
    again = _first_flags(order, own, at)
    repeat[order] = same & ~(same & again)
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(at), _signed(fp), _signed(ctx), pa.array(repeat)], ["doc", "at", "fp", "ctx", "repeat"])


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Two fingerprints of each window named in ``spots`` of doc, text, rank, spots."""
    words, codes, offsets = split_words(batch.column(1))
    hashes = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    starts, docs = [], []
    ranks = batch.column(2).to_numpy()
    for i, (doc, spots) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        own = np.unique(np.concatenate([np.arange(_start(s), _start(s) + _counted(s) + 1) for s in spots if _rank(s) == ranks[i]] or [np.zeros(0, np.int64)]))
        starts.append(own + offsets[i])
        docs.append(np.full(len(own), doc))
    start, doc = np.concatenate(starts), np.concatenate(docs)
    base = np.concatenate([np.full(len(s), offsets[i]) for i, s in enumerate(starts)])
    fp, ctx = Hashes(hashes).of(start, start + WINDOW), Hashes(mix64(hashes), 0xD1342543DE82EF95).of(start, start + WINDOW)
    at = (np.repeat(ranks, [len(x) for x in starts]) << (BITS + STARTS)) | ((start - base) << BITS)
    order = np.lexsort((at, doc, ctx, fp))
    repeat = np.zeros(len(at), bool)
    same = _first_flags(order, fp, ctx)
    again = _first_flags(order, doc, at)
    repeat[order] = same & ~again
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), _signed(fp), _signed(ctx), pa.array(repeat)], ["doc", "at", "fp", "ctx", "repeat"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc, at, fp, ctx, new in order of fp, ctx and time to doc, at and verdict: 1 for a new repeat, 2 for the first entry of its kind where an anchor has several kinds, 0 for the other first new ones."""
    held: tuple | None = None  # fp, ctx, doc, at of the row before; the group's first entry, and whether it was given
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, at, fp, ctx, new = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        out_doc, out_at, verdict = [], [], []
        if held is not None:
            doc, at, fp, ctx = (np.concatenate(([h], x)) for h, x in zip((held[2], held[3], held[0], held[1]), (doc, at, fp, ctx), strict=True))
            new = np.concatenate(([False], new))
        n = len(doc)
        same_fp, same_ctx, same_row = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        same_fp[1:] = fp[1:] == fp[:-1]
        same_ctx[1:] = same_fp[1:] & (ctx[1:] == ctx[:-1])
        same_row[1:] = same_ctx[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        given = bool(held and held[5])
        lead = held[4] if held else None
        repeats = np.flatnonzero(same_ctx & ~same_row & new)
        group = np.cumsum(~same_fp) - 1
        kinds = np.bincount(group, ~same_ctx, group[-1] + 1)
        reps = np.flatnonzero(~same_ctx)
        if held is not None:  # row 0 stands for the group carried over
            reps = reps[reps != 0]
            mine = reps[group[reps] == 0]
            if len(mine) and not given and lead is not None:
                out_doc.append([lead[0]])
                out_at.append([lead[1]])
                verdict.append([2])
                given = True
            several = np.where(group[reps] == 0, True, kinds[group[reps]] > 1)
        else:
            several = kinds[group[reps]] > 1
        out_doc += [doc[repeats], doc[reps[several]]]
        out_at += [at[repeats], at[reps[several]]]
        verdict += [np.full(len(repeats), 1), np.full(int(several.sum()), 2)]
        tail = np.flatnonzero(group == group[-1])
        if held is not None and group[-1] == 0:
            first = lead
        else:
            first, given = (int(doc[tail[0]]), int(at[tail[0]])), kinds[group[-1]] > 1
        held = (fp[-1], ctx[-1], doc[-1], at[-1], first, given)
        if sum(map(len, out_doc)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc), pa.int64()), pa.array(np.concatenate(out_at), pa.int64()), pa.array(np.concatenate(verdict), pa.int32())], ["doc", "at", "verdict"])


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("fp")).sortWithinPartitions("fp", "ctx", "new", "doc", "at").select("doc", "at", "fp", "ctx", "new")


VERDICT = "doc long, at long, verdict int"


class FingerprintIndex:
    """Sorted runs of entries of all documents added so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.runs: list[DataFrame] = []

    def add(self, docs: DataFrame, remember: bool = True) -> DataFrame:
        """Verdicts on the entries of ``docs``, as ``ranked`` gives them, (see ``_judge``) against all documents before; they join the index if ``remember``."""
        rows = arrow_map(docs.select("doc_id", "text", "rank").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), _entries, ENTRY)
        settled = written(rows, "entries")
        run = settled.where(~F.col("repeat")).select("doc", "at", "fp", "ctx")
        if remember:
            run = written(run.repartition(F.col("fp")).sortWithinPartitions("fp", "ctx", "doc", "at"), "run")
        merged = run.withColumn("new", F.lit(True))
        for old in self.runs:
            merged = merged.unionByName(old.withColumn("new", F.lit(False)))
        verdicts = written(_ordered(merged).mapInArrow(releasing(_judge), VERDICT), "verdicts")
        repeats = written(settled.where("repeat").select("doc", "at", F.lit(1).alias("verdict")), "repeats")
        dropped(settled)
        if remember:
            self.runs.append(run)
            if len(self.runs) >= self.fanout:
                self.compact()
        return verdicts.unionByName(repeats)

    def clear(self) -> None:
        """Deletes all runs."""
        for run in self.runs:
            dropped(run)
        self.runs = []

    def compact(self) -> None:
        """All runs become one, with the first entry of each kind."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        first = merged.groupBy("fp", "ctx").agg(F.min(F.struct("doc", "at")).alias("first"))
        new = written(first.select("first.doc", "first.at", "fp", "ctx").repartition(F.col("fp")).sortWithinPartitions("fp", "ctx"), "run")
        for run in self.runs:
            dropped(run)
        self.runs = [new]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, codes, offsets = split_words(batch.column(1))
    names = np.array(words, object)
    texts, sizes, gone = [], [], []
    ranks = batch.column(2).to_pylist()
    for i, spots in enumerate(batch.column(3).to_pylist()):
        own = codes[offsets[i] : offsets[i + 1]]
        cover = np.zeros(len(own) + 1, np.int64)
        for s in spots or ():
            if _rank(s) == ranks[i]:
                cover[_start(s)] += 1
                cover[_start(s) + _counted(s) + WINDOW] -= 1
        keep = np.cumsum(cover)[:-1] == 0
        texts.append(" ".join(names[own[keep]]))
        sizes.append(len(own))
        gone.append(int(len(own) - keep.sum()))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def _cut_digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = _cut(batch)
    return pa.RecordBatch.from_arrays([out.column(0), out.column(2), out.column(3), pa.array([_digest(t) for t in out.column(1).to_pylist()])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def ranked(docs: DataFrame, hidden: str = "rank") -> DataFrame:
    """``docs`` and the place of each row's text among the different texts of its doc_id, 0 but for the few that share a doc_id."""
    own = F.xxhash64("text")
    shared = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("doc_id")
    shared = written(shared, "shared")
    if not shared.limit(1).count():
        return docs.withColumn(hidden, F.lit(0).cast("long"))
    several = docs.select("doc_id", own.alias("hash")).join(shared, "doc_id").distinct()
    several = several.select(F.col("doc_id").alias("of"), "hash", (F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1).cast("long").alias("place"))
    several = written(several, "several")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(several, (F.col("row.doc_id") == F.col("of")) & (F.xxhash64("row.text") == F.col("hash")), "left")
    return rows.select(*(F.col(f"row.`{n}`") for n in docs.columns), F.coalesce("place", F.lit(0).cast("long")).alias(hidden))


def repeated_spots(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc and spots: starts (and numbers of further windows) of all windows that occurred before, of ``docs`` as ``ranked`` gives them.  They join the index in ``batches`` ranges of doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "rank")
    index = FingerprintIndex(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    edges = sorted(set(cuts or []))
    parts = []
    for i in range(len(edges) + 1):
        part = docs
        if i:
            part = part.where(F.col("doc_id") > edges[i - 1])
        if i < len(edges):
            part = part.where(F.col("doc_id") <= edges[i])
        parts.append(index.add(part, remember=i < len(edges)))
    index.clear()
    verdicts = parts[0]
    for part in parts[1:]:
        verdicts = verdicts.unionByName(part)
    doubtful = verdicts.where("verdict = 2").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("at").alias("spots"))
    texts = docs.where(F.col("doc_id").isNotNull()).join(doubtful.hint("merge"), "doc_id").select("doc_id", "text", "rank", "spots")
    windows = written(arrow_map(texts, _windows, ENTRY), "windows")
    late = _ordered(windows.where(~F.col("repeat")).withColumn("new", F.lit(True))).mapInArrow(releasing(_judge), VERDICT).where("verdict = 1")
    repeats = verdicts.where("verdict = 1").select("doc", "at").unionByName(windows.where("repeat").select("doc", "at")).unionByName(late.select("doc", "at"))
    return repeats.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("at").alias("spots"))


def _joined(docs: DataFrame, batches: int) -> DataFrame:
    docs = ranked(docs.select("doc_id", "text"))
    return docs.join(repeated_spots(docs, batches).hint("merge"), "doc_id", "left").select("doc_id", "text", "rank", "spots")


def cut_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, text of the kept words joined by spaces, n_words and n_removed."""
    return arrow_map(_joined(docs, batches), _cut, "doc_id long, text string, n_words long, n_removed long")


def cut_digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the kept words joined by spaces."""
    return arrow_map(_joined(docs, batches), _cut_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_texts(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs, all columns, with repeats cut out of ``text``: the kept words joined by spaces, or the text as it was where none is cut."""
    names = docs.columns
    of, spots = (n + "_" * max(map(len, names)) for n in ("rank", "spots"))  # longer than any name there is
    docs = ranked(docs, of)
    found = repeated_spots(docs.select("doc_id", "text", F.col(of).alias("rank")), batches).select(F.col("doc_id").alias("of"), F.col("spots").alias("found"))
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    joined = rows.join(found.hint("merge"), F.col("row.doc_id") == F.col("of"), "left").select(*(F.col(f"row.`{n}`") for n in docs.columns), F.col("found").alias(spots))
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns[:-2]
        some = np.flatnonzero([s is not None for s in batch.column(batch.num_columns - 1).to_pylist()])
        if len(some):
            part = batch.take(pa.array(some))
            cut = _cut(pa.RecordBatch.from_arrays([pa.array(some), part.column(at), *part.columns[-2:]], ["doc_id", "text", "rank", "spots"]))
            texts = columns[at].to_pylist()
            for i, text, n in zip(some, cut.column(1).to_pylist(), cut.column(3).to_pylist(), strict=True):
                if n:
                    texts[i] = text
            columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return arrow_map(joined, run, fields)
