"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Vectors of one label are dealt to the shards of their ``overlap`` nearest pivots; shards that are too large are
split again by pivots of their own, and each vector keeps its best ``overlap`` shards, so copies stay bounded.  In
every shard each vector gets a list of neighbours by robust pruning; then all pairs of the shard are compared, and
links between groups that the lists don't join are added to them, so that dense groups, whose members' nearest are
all their own, lose no link to each other.  The lists of a vector from all its shards are united.  Then each shard searches for all its vectors at once: a greedy search from the shard's medoid, and
from what is in range, the vector itself included, an expansion along the united lists until nothing new is in range, by cosine in double
precision.  Links leave a shard as a spanning forest.  Then every pair within a component is verified, in blocks
where the component is large, which finds links that no shard held and counts each link once; no pair leaves its
task, only counts do.

``audit`` compares the links of a sample with brute force; when its recall is below ``target`` the graph is built
again with twice the overlap, and after the last overlap all pairs of a label are compared.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or
vec_id, link with nothing and stay in the result (a null vec_id as its own component, null); vectors of another
length are another label; equal vectors are linked like others; rows that repeat with their vec_id count as one
vertex and as one vector; ties go to the smaller vec_id; an empty table gives an empty table; only ``vec_id``,
``embedding`` and ``label`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import written

LINK = 0.93


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and at least one isn't zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(members: DataFrame, pivots: DataFrame, overlap: int) -> DataFrame:
    """Members of large shards dealt to the shards of their nearest pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                shard = batch.column(3).to_numpy()
                _, kind = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
                out_row, out_shard, out_near = [], [], []
                for k, s in np.unique(np.stack([kind, shard], 1), axis=0):  # shards of other kinds have the same numbers
                    rows = np.flatnonzero((kind == k) & (shard == s))
                    own = batch.column(4)[int(rows[0])].values
                    p = _unit(own)
                    near = _unit(batch.column(2).take(pa.array(rows))) @ p.T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                    out_row.append(np.repeat(rows, best.shape[1]))
                    out_shard.append((s * 131 + 1 + best).ravel())
                    out_near.append(np.take_along_axis(near, best, 1).ravel())
                row = pa.array(np.concatenate(out_row))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(np.concatenate(out_shard)), pa.array(np.concatenate(out_near))], ["kind", "vec_id", "embedding", "shard", "near"])

    joined = members.join(pivots, ["kind", "shard"]).select("kind", "vec_id", "embedding", "shard", "pivots")
    return joined.mapInArrow(run, "kind string, vec_id long, embedding array<double>, shard long, near double")


def shards(vectors: DataFrame, overlap: int, most: int, levels: int) -> DataFrame:
    """kind, vec_id, embedding, shard, each shard of at most about ``most`` vectors."""
    members = vectors.select("kind", "vec_id", "embedding", F.lit(0).cast("long").alias("shard"), F.lit(1.0).alias("near"))
    for level in range(levels):
        sizes = members.groupBy("kind", "shard").agg(F.count("*").alias("size")).where(F.col("size") > most)
        sizes = written(sizes, "sizes")
        if not sizes.limit(1).count():
            break
        wanted = F.least(F.lit(128), F.ceil(F.col("size") * (2 * overlap) / most)).cast("int")
        draw = F.abs(F.xxhash64("vec_id", "shard", F.lit(level))) / F.lit(float(1 << 63))
        some = members.join(sizes.withColumn("wanted", wanted), ["kind", "shard"]).where(draw * F.col("size") < F.col("wanted") * 3)
        pivots = some.groupBy("kind", "shard").agg(F.slice(F.sort_array(F.collect_list(F.struct(draw.alias("draw"), "embedding"))), F.lit(1), F.max("wanted")).alias("p"))
        pivots = written(pivots.select("kind", "shard", F.expr("transform(p, x -> x.embedding)").alias("pivots")), "pivots")
        large = _deal(members, pivots, overlap)
        small = members.join(sizes, ["kind", "shard"], "left_anti").select("kind", "vec_id", "embedding", "shard", "near")
        both = large.unionByName(small)
        best = both.groupBy("kind", "vec_id").agg(F.first("embedding").alias("embedding"), F.slice(F.sort_array(F.collect_set(F.struct("near", "shard")), asc=False), 1, overlap).alias("best"))
        members = written(best.select("kind", "vec_id", "embedding", F.inline("best")).select("kind", "vec_id", "embedding", "shard", "near"), "members")
    sizes = members.groupBy("kind", "shard").agg(F.count("*").alias("size"))
    dense = written(sizes.where(F.col("size") > most).withColumn("blocks", F.ceil(F.col("size") / (most // 2)).cast("long")), "dense")
    if dense.limit(1).count():
        # What pivots don't divide lies close together: blocks of it, each pair of blocks a shard.
        split = members.join(dense, ["kind", "shard"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        split = split.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        split = split.select("kind", "vec_id", "embedding", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "near")
        members = members.join(dense, ["kind", "shard"], "left_anti").select("kind", "vec_id", "embedding", "shard", "near").unionByName(split)
    return written(members.select("kind", "vec_id", "embedding", "shard").distinct(), "shards")


def pruned(x: np.ndarray, degree: int = 20, pool: int = 48, alpha: float = 1.2) -> np.ndarray:
    """Neighbours of each row by robust pruning among its ``pool`` nearest; -1 where the list is shorter."""
    m = len(x)
    pool = min(pool, m - 1)
    out = np.full((m, degree), -1, np.int64)
    if pool <= 0:
        return out
    for lo in range(0, m, 256):
        own = np.arange(lo, min(m, lo + 256))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        ids = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(near, ids, 1)))
        order = np.argsort(far, axis=1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        y = x[ids]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(y, y.transpose(0, 2, 1))))
        alive = np.ones_like(ids, bool)
        rows = np.arange(len(own))
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[own[some], k] = ids[rows, pick][some]
            alive &= alpha * between[rows, pick] > far
            alive[rows, pick] = False
    return out


def _joined(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``m`` rows reaches along the edges a, b."""
    least = np.arange(m)
    while True:
        lo = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], lo)
        np.minimum.at(new, least[b], lo)
        while (new != new[new]).any():
            new = new[new]
        if (new == least).all():
            return least
        least = new


def bridges(x: np.ndarray, a: np.ndarray, b: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that, with those among the edges a, b, join all rows that links of the shard join: every pair of rows is compared."""
    m = len(x)
    near = np.concatenate([np.einsum("ad,ad->a", x[a[lo : lo + 32768]], x[b[lo : lo + 32768]]) for lo in range(0, len(a), 32768)] or [np.zeros(0)])
    least = _joined(m, a[near >= link], b[near >= link])
    out_a, out_b = [], []
    for lo in range(0, m, 256):
        hit = x[lo : lo + 256] @ x.T >= link
        for r in np.flatnonzero((hit & (least[lo : lo + 256][:, None] != least)).any(1)):
            to = np.flatnonzero(hit[r] & (least != least[lo + r]))
            parts, first = np.unique(least[to], return_index=True)
            out_a.append(np.full(len(parts), lo + r))
            out_b.append(to[first])
            least[np.isin(least, parts)] = least[lo + r]
    return np.concatenate([*out_a, np.zeros(0, np.int64)]), np.concatenate([*out_b, np.zeros(0, np.int64)])


def _lists(link: float) -> Callable[[pa.Table], pa.Table]:
    """The list of each vector of a shard: its own neighbours, those that list it, and the bridges between groups that no list joins."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = _unit(table.column("embedding"))
        near = pruned(x)
        a, k = np.nonzero(near >= 0)
        b = near[a, k]
        more = bridges(x, a, b, link)
        a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
        pairs = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))
        owner, other = pairs // len(ids), pairs % len(ids)
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[other]))
        return pa.table({"kind": pa.array([table.column("kind")[0].as_py()] * len(ids), pa.string()), "vec_id": ids, "next": lists})

    return run


def _greedy(x: np.ndarray, ends: np.ndarray, to: np.ndarray, own: np.ndarray, beam: int, hops: int, width: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The best rows, and their cosines, that a search from the medoid meets for each of the rows ``own``, along at most ``width`` neighbours of each row."""
    middle = int(np.argmax(x @ x.mean(0)))
    m = len(own)
    best, near = np.full((m, beam), middle), np.full((m, beam), -np.inf)
    near[:, 0] = x[own] @ x[middle]
    opened = np.ones((m, beam), bool)
    opened[:, 0] = False
    seen = np.zeros((m, len(x)), bool)
    seen[:, middle] = True
    active = np.arange(m)
    for _ in range(hops):
        at = np.where(opened[active], -np.inf, near[active])
        pick = at.argmax(1)
        going = at[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        opened[active, pick] = True
        node = best[active, pick]
        slot = ends[node][:, None] + np.arange(width)
        ok = slot < ends[node + 1][:, None]
        step = to[np.where(ok, slot, 0)]
        fresh = ok & ~seen[active[:, None], step]
        seen[np.repeat(active, fresh.sum(1)), step[fresh]] = True
        sims = np.where(fresh, np.einsum("ad,akd->ak", x[own[active]], x[step]), -np.inf)
        all_near = np.concatenate([near[active], sims], 1)
        all_best = np.concatenate([best[active], step], 1)
        all_open = np.concatenate([opened[active], ~fresh], 1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[active], best[active], opened[active] = (np.take_along_axis(v, top, 1) for v in (all_near, all_best, all_open))
    return best, near


def found_in_range(x: np.ndarray, ends: np.ndarray, to: np.ndarray, link: float, beam: int = 8, hops: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the search finds in range, from lists of neighbours ``to[ends[i]:ends[i + 1]]``."""
    out_q, out_at = [], []
    for lo in range(0, len(x), 256):
        own = np.arange(lo, min(len(x), lo + 256))
        best, near = _greedy(x, ends, to, own, beam, hops)
        found = np.zeros((len(own), len(x)), bool)
        hit = near >= link
        found[np.repeat(np.arange(len(own)), hit.sum(1)), best[hit]] = True
        found[np.arange(len(own)), own] = True
        # From all that is in range, along all of the lists, until nothing new is.
        tested = found.copy()
        q, at = np.nonzero(found)
        while len(q):
            ahead = np.zeros_like(found)
            sizes = ends[at + 1] - ends[at]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 20, sizes.sum() + 1, 1 << 20))
            for part in np.split(np.arange(len(q)), cuts):
                n = sizes[part]
                step = to[np.repeat(ends[at[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                ahead[np.repeat(q[part], n), step] = True
            ahead &= ~tested
            tested |= ahead
            q, at = np.nonzero(ahead)
            keep = np.zeros(len(q), bool)
            for i in range(0, len(q), 1 << 15):
                keep[i : i + (1 << 15)] = np.einsum("ad,ad->a", x[own[q[i : i + (1 << 15)]]], x[at[i : i + (1 << 15)]]) >= link
            q, at = q[keep], at[keep]
            found[q, at] = True
        q, at = np.nonzero(found)
        out_q.append(own[q][own[q] != at])
        out_at.append(at[own[q] != at])
    return np.concatenate(out_q), np.concatenate(out_at)


def _search(link: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table.take(pa.array(order)), ids[order]
        x = _unit(table.column("embedding"))
        lists = table.column("next").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        other = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        here = (ids[place] == other) & (place != owner)  # neighbours in this shard
        owner, place = owner[here], place[here]
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        a, b = found_in_range(x, ends, np.append(place, 0), link)
        # Links leave as a forest: of each vector the edge by which a walk over the links first comes to it.
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.searchsorted(a, np.arange(len(ids) + 1))
        parent = np.arange(len(ids))
        reached = np.zeros(len(ids), bool)
        for first in np.flatnonzero(np.diff(starts)):
            if reached[first]:
                continue
            reached[first] = True
            ahead = [int(first)]
            while ahead:
                at = ahead.pop()
                new = b[starts[at] : starts[at + 1]]
                new = np.unique(new[~reached[new]])
                reached[new] = True
                parent[new] = at
                ahead += new.tolist()
        some = np.flatnonzero(parent != np.arange(len(ids)))
        return pa.table({"a": ids[some], "b": ids[parent[some]]})

    return run


def _links(vectors: DataFrame, link: float, overlap: int, most: int, levels: int) -> DataFrame:
    """Links a, b that span what the search finds, from kind, vec_id, embedding."""
    dealt = shards(vectors, overlap, most, levels)
    lists = dealt.groupBy("kind", "shard").applyInArrow(_lists(link), "kind string, vec_id long, next array<long>")
    united = lists.groupBy("kind", "vec_id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    graph = written(dealt.join(united, ["kind", "vec_id"], "left").select("kind", "shard", "vec_id", "embedding", "next"), "graph")
    return written(graph.groupBy("kind", "shard").applyInArrow(_search(link), "a long, b long").distinct(), "found")


def _verify(link: float) -> Callable[[pa.Table], pa.Table]:
    """Links of each vector within one component, or between two blocks of it."""

    def run(table: pa.Table) -> pa.Table:
        ids, own = table.column("vec_id").to_numpy(), table.column("own").to_numpy()
        x = _unit(table.column("embedding"))
        cross = own.min() != own.max() or table.column("low")[0].as_py() != table.column("high")[0].as_py()
        counts = np.zeros(len(ids), np.int64)
        for lo in range(0, len(ids), 512):
            hit = x[lo : lo + 512] @ x.T >= link
            hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
            if cross:
                hit &= own[lo : lo + 512][:, None] != own[None, :]
            counts[lo : lo + 512] = hit.sum(1)
        return pa.table({"vec_id": ids, "n_links": counts})

    return run


def _counts(vectors: DataFrame, label: DataFrame, link: float, most: int) -> DataFrame:
    """vec_id and n_links of every vector in a component."""
    sizes = written(label.groupBy("label").agg(F.ceil(F.count("*") / most).cast("long").alias("blocks")), "sizes")
    members = written(vectors.join(label, vectors["vec_id"] == label["v"]).select("label", "vec_id", "embedding"), "members")
    split = members.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    split = split.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    split = split.select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vec_id", "embedding")
    return split.groupBy("label", "low", "high").applyInArrow(_verify(link), "vec_id long, n_links long").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def audit(vectors: DataFrame, counts: DataFrame, link: float, enough: int = 256) -> float:
    """Share of the links of sampled vectors that the search has found, of all links or as a mean over vectors, whichever is less; 1 where there are none.

    The sample is drawn by hash whatever was found, and grows, to the whole table if need be, until brute force finds
    links of ``enough`` of its vectors.
    """
    parts = vectors.count() // 1024 + 1
    part = F.pmod(F.xxhash64("vec_id", F.lit("audit")), F.lit(parts))
    n, share, due, have, at, width = 0, 0.0, 0, 0, 0, 1
    while at < parts and n < enough:
        picked = vectors.where((part >= at) & (part < at + width)).select("kind", "vec_id", "embedding").toArrow()
        at, width = at + width, min(16, 2 * width)
        if not picked.num_rows:
            continue
        rows, kinds = picked.column("embedding").combine_chunks(), np.array(picked.column("kind").to_pylist(), object)
        ids = picked.column("vec_id").to_numpy()
        own = {k: (ids[kinds == k], _unit(rows.take(pa.array(np.flatnonzero(kinds == k))))) for k in set(kinds.tolist())}
        true = vectors.select("kind", "vec_id", "embedding").mapInArrow(_due(own, link), "vec_id long, due long").groupBy("vec_id").agg(F.sum("due").alias("due"))
        both = true.join(counts.select("vec_id", F.col("n_links").alias("have")), "vec_id", "left").select("due", F.coalesce("have", F.lit(0)).alias("have"))
        row = both.agg(F.count("*").alias("n"), F.sum(F.col("have") / F.col("due")).alias("share"), F.sum("due").alias("due"), F.sum("have").alias("have")).first()
        if row["n"]:
            n, share, due, have = n + row["n"], share + row["share"], due + row["due"], have + row["have"]
    return min(share / n, have / due) if n else 1.0


def _due(own: dict[str, tuple[np.ndarray, np.ndarray]], link: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many of a batch's vectors each of ``own``, ids and unit vectors by kind, is linked with, where any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column(0).to_pylist(), object)
            ids = batch.column(1).to_numpy()
            for k in set(kind.tolist()) & own.keys():
                at = np.flatnonzero(kind == k)
                y = _unit(batch.column(2).take(pa.array(at)))
                some, x = own[k]
                for lo in range(0, len(some), 512):
                    near = x[lo : lo + 512] @ y.T >= link
                    near &= some[lo : lo + 512][:, None] != ids[at][None, :]
                    n = near.sum(1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 512][n > 0]), pa.array(n[n > 0])], ["vec_id", "due"])

    return run


def near_vectors(rows: DataFrame, link: float = LINK, overlap: int = 4, most: int = 512, levels: int = 6, target: float = 0.95, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links, itself included) and kept (the two are equal)."""
    rows = rows.select("vec_id", "embedding", "label")
    kind = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    vectors = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.groupBy("vec_id").agg(F.min(F.struct(kind.alias("kind"), F.col("embedding").cast("array<double>").alias("embedding"))).alias("x")).select("x.kind", "vec_id", "x.embedding")
    vectors = written(vectors, "vectors")
    while True:
        label = components(_links(vectors, link, overlap, most, levels))
        counts = written(_counts(vectors, label, link, block), "counts")
        if not levels or audit(vectors, counts, link) >= target:
            break
        # Without levels each pair of blocks of a label is a shard, so that all pairs of the label are compared.
        overlap, levels = (2 * overlap, levels) if overlap < 64 else (overlap, 0)
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(label, F.col("vec_id") == F.col("v"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
