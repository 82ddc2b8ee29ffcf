"""A toxicity classifier that is penalised for scores that change when identity terms are swapped.

The score is a logistic function of the distinct words of the whole text: each word adds the weights of itself and
of its beginnings.  It is fitted on a bounded number of labelled documents of each class (``per_class``), weighted
back to the frequencies of all labelled rows.  For each fitted document that holds an identity term, every swap
for another term of its group adds the squared change of the score to the loss.

Cases: a null or empty text gets the score of no words; rows that repeat get equal scores; labels that are null
are ignored, labels without documents too, of several labels of a document the largest holds; without labelled
rows the score is 0.5 throughout; an empty table gives an empty table; only ``doc_id`` and ``text`` (and ``toxic``
of labels) are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textutil import arrow_map, split_words

#: Terms of one group stand for one another.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "arab", "chinese", "indian", "mexican"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
PREFIXES = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of a run of non-space characters: each run of letters in lower case, and its beginnings."""
    import xxhash

    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(xxhash.xxh3_64_intdigest(run) >> 1)
        out += [xxhash.xxh3_64_intdigest(f"{run[:n]}*") >> 1 for n in PREFIXES if n <= len(run)]
    return out


@dataclass(frozen=True)
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from fitting: crc32 of its id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(docs: DataFrame) -> DataFrame:
    """doc features of distinct words, as parallel lists of feature and number of words that have it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, codes, offsets = split_words(batch.column(0))
        of_word = [np.array(features(w), np.int64) for w in words]
        ids, times = [], []
        for i in range(batch.num_rows):
            own = np.unique(codes[offsets[i] : offsets[i + 1]])
            f, n = np.unique(np.concatenate([of_word[c] for c in own]) if len(own) else np.zeros(0, np.int64), return_counts=True)
            ids.append(f)
            times.append(n.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), batch.column(1)], ["features", "times", "toxic"])

    return arrow_map(docs, run, "features array<long>, times array<int>, toxic int", rows=64)


def swaps(groups: Sequence[Sequence[str]]) -> dict[int, list[tuple[list[int], list[int]]]]:
    """By the feature of each identity term: its features and those of every other term of its group."""
    return {features(a)[0]: [(features(a), features(b)) for b in g if b != a] for g in groups for a in g}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, keep: int = 4096, fairness: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, steps: int = 300, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> Model:
    """Fits on at most ``per_class`` rows of each label that aren't held out; ``keep`` bounds the features."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model()
    parts = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].union(parts[1])
    text = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    got = _counts(text).toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if not len(y):
        return Model()
    # Hashes become places in a dictionary; of all lists only places, counts and row numbers stay.
    lists = got.column("features").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    known, cols = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    vals = got.column("times").combine_chunks().flatten().to_numpy()
    del got, lists, coded
    of_row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)

    weight = np.where(y == 1, total.get(1, 0) / max(1, (y == 1).sum()), total.get(0, 0) / max(1, (y == 0).sum()))
    weight /= weight.sum()
    n1 = np.bincount(cols[(y == 1)[of_row]], minlength=len(known))
    n0 = np.bincount(cols, minlength=len(known)) - n1
    a, b = (n1 + 0.5) / (y.sum() + 1), (n0 + 0.5) / ((1 - y).sum() + 1)
    z = np.abs(np.log(a / b)) / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    swap = swaps(groups)
    best = np.lexsort((known, -z))[:keep]
    chosen = np.union1d(best[z[best] > 2], np.flatnonzero(np.isin(known, list(swap))))
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[cols] >= 0
    row, col, val = of_row[use], place[cols[use]], vals[use].astype(float)
    del of_row, cols, vals, use

    pairs: list[tuple[list[int], list[int], float]] = []  # features lost and gained by a swap, and the weight of its documents
    at = {int(known[c]): int(place[c]) for c in chosen}
    for f, others in swap.items():
        if f in at:
            share = float(weight[np.unique(row[col == at[f]])].sum())
            pairs += [([at[x] for x in lost if x in at], [at[x] for x in won if x in at], share / len(others)) for lost, won in others if share]

    m = len(chosen)
    w, bias = np.zeros(m), float(np.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5)))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    square = np.bincount(row, val * val, len(y))
    rate = 1.0 / (0.25 * float((weight * (square + 1)).sum()) * 4 + l2 + 2 * fairness * sum(2 * s * (len(p) + len(q)) for p, q, s in pairs) + 1e-9)
    for _ in range(steps):
        margin = ahead_bias + np.bincount(row, ahead[col] * val, len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        slope = np.bincount(col, error[row] * val, m) + l2 * ahead
        for lost, won, share in pairs:
            change = ahead[won].sum() - ahead[lost].sum()
            np.add.at(slope, won, 2 * fairness * share * change)
            np.add.at(slope, lost, -2 * fairness * share * change)
        new = ahead - rate * slope
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_bias = ahead_bias - rate * error.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_next * (new - w), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
    return Model(float(bias), {int(known[c]): float(v) for c, v in zip(chosen, w, strict=True) if v})


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """All columns of docs (``text`` only if kept), then score (0 to 1) and predicted (score >= threshold); columns of these names are replaced."""
    known: dict[str, float] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, codes, offsets = split_words(batch.column(batch.schema.get_field_index("text")))
        if len(known) > 100_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = model.word(w)
        of_word = np.fromiter(map(known.__getitem__, words), float, len(words))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        live = np.flatnonzero(of_word[codes] != 0) if len(codes) else codes
        pairs = np.unique(doc[live] * np.int64(len(words) or 1) + codes[live])
        margin = model.bias + np.bincount(pairs // (len(words) or 1), of_word[pairs % (len(words) or 1)] if len(pairs) else None, batch.num_rows)
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        kept = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if keep_text or n != "text"}
        return pa.RecordBatch.from_arrays([*kept.values(), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != "text")
    return arrow_map(docs, run, f"{fields}, score double, predicted int")
