"""Substring, near-duplicate and vector deduplication and the exact search against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_topk, near_dedup, vector_links
from tidemark.llm.components import components
from tidemark.llm.exact_topk import top_products
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.substring_dedup import FingerprintIndex, cut_digests, cut_repeats, cut_texts
from tidemark.llm.vector_links import near_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_literally(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    return out


def passages(n, seed):
    """Documents over few words, with shared passages, loops and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [[word() for _ in range(rng.randint(15, 70))] for _ in range(6)]
    out = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randint(0, 40))] if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.1:
            parts.append(["loop", "of", "words"] * 30)
        out.append((i, " ".join(w for p in parts for w in p)))
    return out + [(n + i, t) for i, (_, t) in enumerate(rng.sample(out, n // 5))]


@pytest.mark.parametrize(("seed", "batches"), [(0, 1), (1, 2), (2, 6)])
def test_substrings_equal_brute_force(spark, seed, batches):
    rows = passages(80, seed)
    got = cut_digests(spark.createDataFrame(rows, "doc_id long, text string"), batches).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == cut_literally(rows)


def test_batches_added_later_are_held_against_all_before(spark):
    text = " ".join(f"a{i}" for i in range(40))
    one, two = (spark.createDataFrame([(i, text, 0)], "doc_id long, text string, rank long") for i in (1, 2))
    index = FingerprintIndex(spark, fanout=2)
    assert index.add(one).where("verdict = 1").count() == 0
    assert index.add(two).where("verdict = 1").count() > 0
    assert len(index.runs) == 1  # compacted
    assert index.add(spark.createDataFrame([(3, text, 0)], "doc_id long, text string, rank long")).where("verdict = 1").count() > 0
    index.clear()


def test_several_texts_of_one_doc_id(spark):
    """They are parts of one document in order of their hashes."""
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(20, 90))
    rows = [(1, "short text"), (1, long), (1, other), (1, other), (2, long), (3, other + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:3] + (len(r["text"].split()),) for r in cut_repeats(df).select("doc_id", "n_words", "n_removed", "text").collect())
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    first = 40 if hashes[other] < hashes[long] else 0  # words of the later of the two that the earlier has
    want = [(1, 2, 0, 2), (1, 60, first, 60 - first), *[(1, 70, 40 - first, 30 + first)] * 2, (2, 60, 60, 0), (3, 71, 70, 1)]
    assert got == sorted(want)
    assert sorted(r["text"] for r in cut_texts(df).collect()) == sorted(r["text"] for r in cut_repeats(df).collect())


def test_odd_rows_of_substrings(odd, none):
    want = cut_literally([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = cut_digests(odd).collect()
    assert len(got) == 11
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
    assert cut_digests(none).count() == cut_repeats(none).count() == cut_texts(none).count() == 0
    kept = cut_texts(odd)
    assert kept.columns == odd.columns and kept.count() == 11
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1] is None and texts[3] == " \t\n " and texts[9] == ""


def link_literally(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def edited(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 120))] for _ in range(n)]
    out = []
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return list(enumerate(out))


def test_near_duplicates_equal_brute_force(spark):
    rows = edited(120, 0)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == link_literally(rows)


def test_a_repeated_document_is_held_against_the_other_of_its_pair(spark):
    rows = []
    for i in range(20):  # similarity 0.6, and the smaller doc_id occurs twice
        words = [f"w{i}x{k}" for k in range(100)]
        other = words[:76] + [f"y{i}x{k}" for k in range(24)]
        rows += [(2 * i, " ".join(words)), (2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and {r["doc_id"]: tuple(r)[1:] for r in got} == link_literally(rows)


def test_large_nodes_branch_and_end_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):  # one group whose members differ, so that nodes stay large and forests get refuted
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(90)] = f"y{rng.randint(0, 9999)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    real = near_dedup._candidates
    monkeypatch.setattr(near_dedup, "_candidates", lambda classes: real(classes, small=16, levels=2))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == link_literally(rows)


def test_odd_rows_of_near_duplicates(odd, none):
    got = near_duplicates(odd).collect()
    want = link_literally([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert len(got) == 11
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 1, None, True)]
    assert near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(links)
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n, seed, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    out = []
    for i in range(n):
        v = base[rng.integers(i)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.15, 0.3]) if i and rng.random() < 0.5 else base[i]
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return out


def links_literally(rows):
    ok = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = [np.array(r[1]) / np.linalg.norm(r[1]) for r in ok]
    label, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93:
                n[ok[a][0]] += 1
                n[ok[b][0]] += 1
                lo, hi = sorted((top(ok[a][0]), top(ok[b][0])))
                label[hi] = lo
    return {i: (n[i], top(i), top(i) == i) for i in n}


ODD_VECTORS = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0] * 16, None), (904, [1.0] * 16, 1), (905, [1.0] * 16, 1), (906, [None] + [1.0] * 15, 1), (907, [], 1), (908, [1.0, 2.0], 1), (950, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("most", [512, 60])
def test_vector_links_equal_brute_force(spark, most):
    rows = vectors(250, 0) + ODD_VECTORS
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as shard", "2 as v")
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(df, most=most).collect()}
    want = links_literally(rows)
    found, due = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and 0.95 * due <= found <= due
    if most > 250:
        assert got == want


def test_vectors_beyond_single_precision(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [1e300, 1e299], 1), (3, [1e-50, 0.0], 2), (4, [1e-50, 1e-51], 2), (5, [1.0, 0.0], 3), (6, [1.0, 1e300], 3), (7, [0.0, 5e-324], 4), (8, [0.0, 1.0], 4)]
    rows += [(9, [1.0, float(np.sqrt(1 / 0.93**2 - 1)) + 1e-9], 5), (10, [1.0, 0.0], 5), (11, [1.0, float(np.sqrt(1 / 0.93**2 - 1)) - 1e-9], 6), (12, [1.0, 0.0], 6)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: g[:2] for i, g in got.items()} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9), 10: (0, 10), 11: (1, 11), 12: (1, 11)}


def test_linked_dense_groups_of_vectors_are_joined(spark):
    """Each vector's nearest are all of its own group; two groups' centres have cosine 0.95, and searches start in a third, larger one."""
    rng = np.random.default_rng(3)
    one, two = np.eye(16)[0], 0.95 * np.eye(16)[0] + np.sqrt(1 - 0.95**2) * np.eye(16)[1]
    rows = []
    for k, noise in enumerate((0.0, 0.002)):
        groups = [c + noise * rng.normal(size=16) for c, n in ((one, 200), (two, 200), (np.eye(16)[2], 500)) for _ in range(n)]
        rows += [(1000 * k + i, [float(np.float32(v)) for v in x], k) for i, x in enumerate(groups)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == links_literally(rows)
    assert {v[1] for v in got.values()} == {0, 400, 1000, 1400}


def test_labels_split_several_times_are_dealt_by_their_own_pivots(spark):
    """Share of links found by production overlap before any retry; the third label holds shorter vectors."""
    rng = np.random.default_rng(4)
    rows = []
    for k, d in enumerate((16, 16, 12)):
        base = rng.normal(size=(400, d))
        rows += [(10000 * k + i, (base[i % 400] + 0.1 * rng.normal(size=d)).tolist(), f"{k}/{d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string")
    df = df.orderBy(F.xxhash64("vec_id"))  # kinds mixed in every slice
    found = components(vector_links._links(df, 0.93, 4, 100, 6))
    have = vector_links._counts(df, found, 0.93, 2048).agg(F.sum("n_links")).first()[0]
    due = 0
    for k in {r[2] for r in rows}:
        x = np.array([r[1] for r in rows if r[2] == k])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        due += int((x @ x.T >= 0.93).sum()) - len(x)
    assert 0.95 * due <= have <= due


def test_audit_sees_lost_links_of_few_vectors(spark):
    """2 % of vectors have links, and those of half of the pairs are lost."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24))
    x[1:80:2] = x[0:80:2]
    vectors = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "kind string, vec_id long, embedding array<float>")
    counts = spark.createDataFrame([(i, 1) for i in range(40)], "vec_id long, n_links long")
    assert 0.4 <= vector_links.audit(vectors, counts, 0.93) <= 0.6


def test_all_pairs_are_compared_when_the_last_overlap_misses_the_target(spark, monkeypatch):
    rows = vectors(250, 0)
    monkeypatch.setattr(vector_links, "audit", lambda *_: 0.0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    real = vector_links._links
    # Every graph but one of all pairs loses all links.
    monkeypatch.setattr(vector_links, "_links", lambda v, link, overlap, most, levels: real(v, link, overlap, most, levels) if not levels else v.sparkSession.createDataFrame([], "a long, b long"))
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(df, overlap=64, most=60).collect()}
    assert got == links_literally(rows)


def test_vector_tables_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(none).count() == 0 and top_products(none).count() == 0


def products_literally(rows):
    ok = [(r[0], [int(v) for v in np.floor(256 * np.array(r[1], float))]) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i and len(x) == len(q))[:5]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "query_block", "slices"), [(1024, 1024, 8), (40, 3, 4), (7, 100, 1)])
def test_top_products_equal_brute_force(spark, monkeypatch, tile, query_block, slices):
    rows = vectors(300, 2) + ODD_VECTORS + [(None, [1.0] * 16, 1), (1000, [0.5] * 16, None), (1001, [0.5] * 16, 2), (1050, [2.0**20] * 16, 1), (1051, [2.0**19 + 0.3] * 16, 1)]
    monkeypatch.setattr(exact_topk, "TILE", tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as score", "2 as rank")
    got = sorted(tuple(r) for r in top_products(df, query_block=query_block, slices=slices).collect())
    assert got == products_literally(rows)


def test_the_cutoff_leaves_few_entries_to_resolve(spark):
    """Parts of all but the last slice rule out nine of ten entries, and the first phase's cutoffs are not above the k-th best."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x[1::2] = x[::2] + 0.3 * rng.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids = np.arange(4000)
    asked = exact_topk.Asked(ids[:1000:50], x[:1000:50], np.full(20, -np.inf))
    sent = [exact_topk.leading(asked, ids[lo : lo + 1000], x[lo : lo + 1000], 5, 8) for lo in range(0, 4000, 1000)]
    of, score = np.concatenate([s[0] for s in sent]), np.concatenate([s[2] for s in sent])
    true = asked.x @ x.T
    true[np.arange(20), asked.ids] = -np.inf
    cutoff = np.array([np.sort(score[of == i])[-5] for i in range(20)], float)
    assert (cutoff <= np.sort(true, 1)[:, -5]).all() and (np.bincount(of) == 20).all()
    of, at, score, resolved = exact_topk.reaching(asked._replace(cutoff=cutoff), ids, x, 8)
    assert resolved < 0.1 * true.size
    assert {*zip(of.tolist(), at.tolist(), score.tolist(), strict=True)} == {(i, j, int(true[i, j])) for i, j in zip(*np.nonzero(true >= cutoff[:, None]), strict=True)}


def test_the_plan_of_top_products_copies_no_vectors(spark):
    df = spark.createDataFrame(vectors(100, 2), "vec_id long, embedding array<float>, label int")
    plan = top_products(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "CoGroup" not in plan
