"""Near-duplicate documents by chosen-path similarity join of their shingle sets.

A document's set holds the distinct runs of five words of its text in lower case.  Equal sets are one class.  Each
class has minwise values of its set.  In each of several independent trees, a node's documents are dealt to child
nodes by their minwise value at positions that the node's path selects; a node that is small enough is compared
exhaustively by the minwise values, a large one branches again, and one that stays large at the last level is
compared in blocks.  Pairs that may reach the threshold are confirmed on the full sets.

A pair at the threshold shares a child of a node with chance 1 - (1 - similarity)**branches = 0.94 by the default
parameters.  Where no node branches again it misses all five trees with chance 1e-6, where its nodes branch three
times with chance 2e-4.  A pair in a common node is passed over only when its minwise agreement is four standard
deviations low.

A node emits the pairs of a spanning forest with the most agreement instead of all pairs, which gives the same
components if the forest's pairs are confirmed.  Where they are not, so that a node still holds documents of
different components, the node is compared exhaustively on the full sets.  Either way a node's output is linear.

Cases: a null or empty text has an empty set, linked with nothing; fewer than five words are one shingle; rows
that repeat with their doc_id give equal rows; a null doc_id is linked with nothing, has no component and is kept;
ties go to the smaller doc_id; very long texts are sets like others; an empty table gives an empty table; only
``doc_id`` and ``text`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import written
from tidemark.llm.substring_dedup import Hashes
from tidemark.llm.textutil import arrow_map, mix64, releasing, split_words, word_hashes

SHINGLE, VALUES = 5, 64
LINK = 75  # per cent
TREES, BRANCHES, LEVELS, SMALL = 5, 2, 3, 2048
#: Agreeing minwise values out of VALUES: fewer rule a pair out.
LEAST = 34
ODD = (mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)).tolist()


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the distinct shingles of every text, in this order."""
    words, codes, offsets = split_words(pc.ascii_lower(pc.fill_null(column, "")))
    sums = Hashes(word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64))
    sizes = np.diff(offsets)
    runs = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), runs)
    start = np.repeat(offsets[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    width = np.minimum(sizes, SHINGLE)[doc]
    value = sums.of(start, start + width)
    value = np.where(width < SHINGLE, mix64(value + width.astype(np.uint64)), value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, value = shingle_sets(batch.column(1))
    sizes = np.bincount(doc, minlength=batch.num_rows)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    one, two = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
    least = np.zeros((batch.num_rows, VALUES), np.uint32)
    if len(full):
        with np.errstate(over="ignore"):
            one[full] = np.add.reduceat(mix64(value), starts)
            two[full] = np.add.reduceat(mix64(~value), starts)
            for i, odd in enumerate(ODD):
                least[full, i] = np.minimum.reduceat(value * np.uint64(odd), starts) >> np.uint64(32)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in least], pa.binary())],
        ["doc_id", "n_shingles", "one", "two", "least"],
    )


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _chosen(path: np.ndarray, branch: int) -> np.ndarray:
    """The position that each path selects for a branch."""
    return (mix64(path + mix64(np.array([branch + 1], np.uint64))) % np.uint64(VALUES)).astype(np.int64)


def _child(path: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix64(path ^ mix64(at.astype(np.uint64) * np.uint64(1 << 32) + value.astype(np.uint64)))


ROW = "path long, rep long, n long, sketch binary"


def _roots(trees: int, branches: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Rows of rep, n, least to the first level of all trees; sketch: the lowest byte of each minwise value."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = _matrix(batch.column(2), np.uint32, VALUES)
        sketch = pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary())
        out = []
        for tree in range(trees):
            root = mix64(np.full(batch.num_rows, tree, np.uint64))
            for branch in range(branches):
                at = _chosen(root, branch)
                path = _child(root, at, least[np.arange(len(least)), at])
                out.append(pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0), batch.column(1), sketch], ["path", "rep", "n", "sketch"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def _branch(branches: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        path = batch.column(0).to_numpy().view(np.uint64)
        sketch = _matrix(batch.column(3), np.uint8, VALUES)
        out = []
        for branch in range(branches):
            at = _chosen(path, branch)
            child = _child(path, at, sketch[np.arange(len(sketch)), at])
            out.append(pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *batch.columns[1:]], batch.schema.names))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def _agreement(sketch: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketch), len(sketch)), np.uint8)
    for i in range(VALUES):
        out += sketch[:, i][:, None] == sketch[:, i][None, :]
    return out


def _sizes_fit(n: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n[:, None], n[None, :]) >= LINK * np.maximum(n[:, None], n[None, :])


def _forest(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a heaviest spanning forest of a matrix of weights, 0 for no edge."""
    m = len(weight)
    best, via, left = np.zeros(m, weight.dtype), np.zeros(m, np.int64), np.ones(m, bool)
    a, b = [], []
    for _ in range(m):
        at = int(np.where(left, best, -1).argmax()) if left.any() else -1
        if not left[at]:
            break
        if best[at] > 0:
            a.append(via[at])
            b.append(at)
        left[at] = False
        closer = left & (weight[at] > best)
        best[closer] = weight[at][closer]
        via[closer] = at
    return np.array(a, np.int64), np.array(b, np.int64)


def _node(rep: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """Pairs of a node to confirm, and whether others stay that may be links."""
    may = _agreement(sketch).astype(np.int16)
    may[(may < LEAST) | ~_sizes_fit(n) | (rep[:, None] == rep[None, :])] = 0
    a, b = _forest(may)
    return (rep[a], rep[b]), np.count_nonzero(may) > 2 * len(a)


FOUND = "a long, b long, path long, rep long, n long, sketch binary"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of path as batches of whole nodes, and where nodes start and the last ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        path = both.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1))
        held = [both.slice(cuts[-1])]
        if len(cuts) > 1:
            yield both, cuts
    for last in held:
        yield last, np.array([0, last.num_rows])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW in order of path to pairs to confirm (a, b), and the rows of nodes with further pairs."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch, cuts in _paths(batches):
        rep, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        sketch = _matrix(batch.column(3), np.uint8, VALUES)
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        may = ((sketch[two] == sketch[two + 1]).sum(1) >= LEAST) & (100 * np.minimum(n[two], n[two + 1]) >= LINK * np.maximum(n[two], n[two + 1])) & (rep[two] != rep[two + 1])
        found = [(rep[two[may]], rep[two[may] + 1])]
        still = []
        for k in np.flatnonzero(sizes > 2):
            lo, hi = cuts[k], cuts[k + 1]
            pairs, more = _node(rep[lo:hi], n[lo:hi], sketch[lo:hi])
            found.append(pairs)
            if more:
                still.append(np.arange(lo, hi))
        if still:
            at = pa.array(np.concatenate(still))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(c.take(at) for c in batch.columns)], names)
        a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        if len(a):
            none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], names)


def _candidates(classes: DataFrame, trees: int = TREES, branches: int = BRANCHES, levels: int = LEVELS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b to confirm, and the rows (path, rep, n, sketch) of nodes with further pairs, of classes with rep, n, least.

    Nodes are counted first, which combines before the shuffle, so that no task gathers a node that is too large.
    """
    rows = arrow_map(classes.select("rep", "n", "least"), _roots(trees, branches), ROW, rows=4096)
    pairs: DataFrame | None = None
    still: DataFrame | None = None
    for level in range(levels + 1):
        large = None
        if level < levels:
            over = written(rows.groupBy("path").agg(F.count("*").alias("size")).where(F.col("size") > small), "over")
            if over.limit(1).count():
                large = rows.join(over, "path")
                rows = rows.join(over, "path", "left_anti")
        found = written(rows.repartition(F.col("path")).sortWithinPartitions("path").mapInArrow(releasing(_compare), FOUND), "nodes")
        new = found.where("a is not null").select("a", "b")
        pairs = new if pairs is None else pairs.unionByName(new)
        more = found.where("path is not null").select("path", "rep", "n", "sketch")
        still = more if still is None else still.unionByName(more)
        if large is None:
            break
        if level < levels - 1:
            rows = written(arrow_map(large.select("path", "rep", "n", "sketch"), _branch(branches), ROW, rows=4096), "branches")
        else:
            # What stays large is compared in blocks, each pair of blocks a node of its own.
            split = large.withColumn("blocks", F.ceil(F.col("size") / (small // 2)).cast("long"))
            split = split.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
            rows = split.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "rep", "n", "sketch")
    return pairs.distinct(), still


def _texts_to_sets(texts: list[str | None]) -> list[np.ndarray]:
    doc, value = shingle_sets(pa.array(texts, pa.string()))
    return np.split(value, np.searchsorted(doc, np.arange(1, len(texts))))


def _full_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _texts_to_sets(batch.column(1).to_pylist())], pa.binary())], ["rep", "shingles"])


def _intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets named in ``rows`` with all sets."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = (times > 1)[at]
    doc, at = doc[keep], (np.cumsum(times > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (first, first + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[doc[a:b], at[a:b] - first] = 1
        out += has[rows] @ has.T
    return out


def _exhaustive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of path, rep, n, sketch, label, shingles in order of path to links (a, b) that join components of a node."""
    for batch, cuts in _paths(batches):
        out = []
        rep, n, label = (batch.column(i).to_numpy() for i in (1, 2, 4))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = slice(lo, hi)
            may = (_agreement(_matrix(batch.column(3).slice(lo, hi - lo), np.uint8, VALUES)) >= LEAST) & _sizes_fit(n[own]) & (label[own][:, None] != label[own][None, :])
            use = np.flatnonzero(may.any(1))
            if not len(use):
                continue
            # Of two documents that may still link, one at least is outside the largest component.
            kinds, of, times = np.unique(label[own][use], return_inverse=True, return_counts=True)
            odd = np.flatnonzero(of != times.argmax())
            sets = [np.frombuffer(batch.column(5)[int(lo + i)].as_py(), np.uint64) for i in use]
            both = _intersections(sets, odd)
            size = n[own][use].astype(np.float64)
            linked = np.zeros((len(use), len(use)), np.int8)
            linked[odd] = may[np.ix_(use[odd], use)] & (100.0 * both >= LINK * (size[odd][:, None] + size[None, :] - both))
            a, b = _forest(np.maximum(linked, linked.T))
            out.append((rep[own][use][a], rep[own][use][b]))
        if out:
            a, b = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a, b, doc_id, text in order, those of a before those of b, to a, b, linked, for each two texts of a and b."""
    pair: tuple[int, int] | None = None
    left: dict[str, None] = {}
    right: set[str] = set()
    for batch in batches:
        a, b, doc, text = (batch.column(i).to_pylist() for i in range(4))
        out: list[tuple[int, int]] = []
        sides: list[str] = []
        for *own, of, t in zip(a, b, doc, text, strict=True):
            if pair != tuple(own):
                pair, left, right = (own[0], own[1]), {}, set()
            if of == pair[0]:
                left[t] = None
            elif t not in right:
                right.add(t)
                for x in left:
                    out.append(pair)
                    sides += [x, t]
        linked = []
        for at in range(0, len(sides), 64):
            sets = _texts_to_sets(sides[at : at + 64])
            for x, y in zip(sets[::2], sets[1::2], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= LINK * (len(x) + len(y) - both))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    sides = pairs.select(F.col("a").alias("doc_id"), "a", "b").unionByName(pairs.select(F.col("b").alias("doc_id"), "a", "b"))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(sides.hint("merge"), "doc_id").select("a", "b", "doc_id", "text")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "doc_id").select("a", "b", "doc_id", "text").mapInArrow(releasing(_confirm), "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and kept (the two are equal)."""
    docs = docs.select("doc_id", "text")
    sets = written(arrow_map(docs, _sets, "doc_id long, n_shingles long, one long, two long, least binary"), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("one", "two", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.min("least").alias("least"), F.count("*").alias("copies")), "classes")
    pairs, still = _candidates(classes)
    judged = written(_confirmed(written(pairs, "pairs"), docs), "judged")
    links = judged.where("linked").select("a", "b")
    label = components(links)
    # Nodes that still hold several components, though further pairs of theirs may be links.
    named = still.join(label, still["rep"] == label["v"], "left").select("path", "rep", "n", "sketch", F.coalesce("label", "rep").alias("label"))
    named = written(named, "open")
    apart = written(named.groupBy("path").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("path"), "apart")
    named = written(named.join(apart, "path"), "open")
    if named.limit(1).count():
        texts = docs.join(named.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id").select("doc_id", "text").distinct()
        full = arrow_map(texts, _full_sets, "rep long, shingles binary", rows=128)
        rows = named.join(full, "rep").select("path", "rep", "n", "sketch", "label", "shingles")
        more = written(rows.repartition(F.col("path")).sortWithinPartitions("path").mapInArrow(releasing(_exhaustive), "a long, b long").distinct(), "links")
        if more.limit(1).count():
            label = components(links.unionByName(more))
    copied = written(classes.where("copies > 1").select("one", "two", F.col("n").alias("n_shingles"), "rep"), "copied")
    named = sets.select("doc_id", "n_shingles", "one", "two").join(copied, ["one", "two", "n_shingles"], "left")
    named = named.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    out = named.join(label, named["rep"] == label["v"], "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
