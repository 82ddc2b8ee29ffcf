"""Toxicity, personal data, page extraction and the pipeline."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_blocks as H
from tidemark.llm import pii
from tidemark.llm import queries as Q
from tidemark.llm import toxicity as T

from .test_dedup import WORD, cut_literally, link_literally

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_model(spark):
    return T.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))


def test_held_out_accuracy(spark, toxic_model):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(docs, labels)
    rows = T.score(docs, model, keep_text=False).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).select("toxic", "predicted").toPandas()
    caught = rows["predicted"][rows["toxic"] == 1].mean()
    wrong = rows["predicted"][rows["toxic"] == 0].mean()
    assert caught > 0.8 and wrong < 0.01


def test_swapped_identity_terms_score_alike(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{rng.randint(0, 300)}" for _ in range(30)]
        if toxic:
            words.append("vile")
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslim")  # a term that the labels lean against
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, fair = T.fit(docs, labelled, fairness=0.0), T.fit(docs, labelled, fairness=50.0)
    gap = lambda m: abs(m.word("muslim") - m.word("christian"))
    assert gap(fair) < 0.2 * gap(free) and fair.word("vile") > 1


def test_odd_rows_of_toxicity(spark, odd, none, toxic_model):
    got = T.score(odd, toxic_model)
    assert got.count() == 11 and got.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[1] == by[2] == by[3] and all(0 <= s <= 1 for s in by.values())
    assert T.score(none, toxic_model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(odd, T.fit(odd, empty)).select("score").distinct().collect()[0][0] == 0.5
    some = spark.createDataFrame([(4, 1), (4, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    assert T.score(odd, T.fit(odd, some)).count() == 11


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "x.y@foo", "-d@e.f", "_d@e.f", "@", "1.2.3.4", ".5.6", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", " 12345678901234567890", " ", "+1 (555) 123-4567", "+", "+49 30 1234567 ", "é🙂", "4", "\n", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(800)] + [(800, None), (801, ""), (802, "1 " * 20_000), (803, "a" * 30_000 + "@b" + ".c" * 10_000), (804, "1" * 40_000)]
    for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = base_spans(rows[r["doc_id"]][1])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w[2] == k for w in want) for k in PATTERNS]
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def term_spans(rows, disclose=0.6, share=0.75, prior=0.5):
    """Terms of every text, by counting documents one by one."""
    word = re.compile(r"[^\W\d_]{3,}")
    texts = [t or "" for _, t in rows]
    have = [{(k, t[a:b].lower()) for a, _, k, b in base_spans(t)} for t in texts]
    said = [{w.lower() for w in word.findall(t)} for t in texts]
    out = []
    for t, own in zip(texts, have, strict=True):
        found = []
        for m in word.finditer(t):
            if any(a < m.end() and m.start() < b for a, _, _, b in base_spans(t)):
                continue
            for e in own:
                with_word = [i for i, s in enumerate(said) if m.group().lower() in s]
                both = [i for i in with_word if e in have[i]]
                n = len({texts[i] for i in both})
                given, general = len(both) / len(with_word) * n / (n + prior), sum(e in h for h in have) / len(rows)
                if general < 1 and given >= 2**-disclose and np.log2(given / general) >= -share * np.log2(general):
                    found.append((m.start(), m.end()))
                    break
        out.append(found)
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(8)
    names, people = [f"name{x}" for x in "abcdefgh"], [f"p{i}@x.com" for i in range(6)] + ["10.0.0.1", "+1 555 123 4567"]
    rows = []
    for i in range(120):
        parts = [rng.choice(["tea", "rain", "Milk", "día", "of", "road", "tree"]) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.4:
            k = rng.randrange(8)
            parts += [names[k].title(), people[k]] if rng.random() < 0.8 else [names[k]]
        if rng.random() < 0.05:
            parts.append("".join(rng.choice("xyzé") for _ in range(6)))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None), (301, "")]
    want = term_spans(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), spans in zip(rows, want, strict=True):
        assert [s for s in got[i].split(",") if s.startswith("term:")] == [f"term:{a}:{b}" for a, b in spans]
    assert any(want)


@pytest.mark.parametrize("unit", ["1.2.3.4 ", "1 "])
def test_many_matches_in_one_text(spark, unit):
    text = "".join(unit if i % 3 else f"name{i % 7}x a{i}@b.cc " for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "tea")], "doc_id long, text string")
    short = spark.createDataFrame([(1, text[:300]), (2, "tea")], "doc_id long, text string")
    pii.digests(short).collect()  # code is compiled
    began = time.time()
    pii.digests(short).collect()
    between = time.time()
    assert pii.digests(df).where("doc_id = 1").first()["n_email"] == 33_334
    assert time.time() - between < between - began + 10
    assert pii.sanitise(df).where("doc_id = 1").first()["text"].count("[EMAIL]") == 33_334


def test_terms_that_give_an_entity_away_are_generalised(spark):
    rows = [(i, f"zorblax wrote from zed@corp.com about tea number {i}. Zorblax again.") for i in range(4)]
    rows += [(10 + i, f"someone wrote again about tea number from here {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(df).collect()}
    found = [rows[1][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans[1].split(",")) if k == "term"]
    assert found == ["zorblax", "Zorblax"] and spans[10] == ""
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert texts[1] == "[TERM] wrote from [EMAIL] about tea number 1. [TERM] again." and texts[12] == rows[6][1]
    gone = {r["doc_id"]: r["text"] for r in pii.sanitise(df, remove=0.2).collect()}
    assert gone[1] == " wrote from [EMAIL] about tea number 1.  again."


def sanitised(text, marks):
    out, at = [], 0
    for a, b, by in sorted(marks):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_rewriting_in_pieces_equals_rewriting_whole(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(30):
        text = "".join(rng.choice("aé🙂 ") for _ in range(rng.choice([0, 5, 1023, 1024, 1025, 5000])))
        cuts = [(a, min(len(text), a + rng.choice([1, 3, 30, 2500])), rng.choice(["", "[X]"])) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 20)))] if text else []
        rows.append((f"{i} {text}", sanitised(f"{i} {text}", [(a + len(f"{i} "), b + len(f"{i} "), by) for a, b, by in dict((c[:2], c) for c in cuts).values()])))
        marks += [(rows[-1][0], a + len(f"{i} "), b + len(f"{i} "), by) for a, b, by in dict((c[:2], c) for c in cuts).values()]
    docs = spark.createDataFrame([r[:1] for r in rows], "text string")
    got = pii._rewritten(docs.select("text", F.xxhash64("text").alias("hash")), spark.createDataFrame(marks, "text string, start long, end long, by string").select(F.xxhash64("text").alias("hash"), "start", "end", "by"))
    new = {r["hash"]: r["text"] for r in got.collect()}
    for r in docs.select("text", F.xxhash64("text").alias("hash")).collect():
        want = dict(rows)[r["text"]]
        assert new.get(r["hash"], r["text"]) == want


def test_a_term_far_from_an_entity_of_two_documents_is_generalised(spark):
    filler = " ".join(f"about tea and the {'weather rain'.split()[i % 2]} today" for i in range(20))
    rows = [(i, f"Zorblax began. {filler} write to zed@corp.com") for i in range(2)]
    rows += [(10 + i, f"someone began. {filler} write {i}") for i in range(400)]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[0] == texts[1] == f"[TERM] began. {filler} write to [EMAIL]"
    assert texts[10] == rows[2][1]


def test_odd_rows_of_personal_data(odd, none):
    assert pii.digests(odd).count() == 11 and pii.digests(none).count() == 0 and pii.sanitise(none).count() == 0
    got = pii.sanitise(odd)
    assert got.columns == odd.columns and got.count() == 11
    assert {r["doc_id"]: r["text"] for r in got.collect()}[6] == "[TERM] é漢🙂 [EMAIL] [IP] [TERM]"


def test_personal_data_of_rows_with_a_null_id_are_masked(spark):
    rows = [(None, "write to a@b.cc"), (None, "from 1.2.3.4"), (None, "tea"), (None, None), (1, "a@b.cc")]
    got = [tuple(r) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "write to [EMAIL]"), (None, "from [IP]"), (None, "tea"), (None, None), (1, "[EMAIL]")], key=str)


def test_labeller_on_pages_it_has_not_seen():
    model, rng = H.trained(), random.Random(12345)
    made = [H.made_page(rng) for _ in range(200)]
    pages = [H.blocks(p) for p, _ in made]
    right = total = 0
    for (page, want), yes in zip(made, H.label(model, pages), strict=True):
        _, y = H.labelled(page, want)
        right += int((yes == (y > 0)).sum())
        total += len(y)
    assert right / total > 0.98


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = H.Labeller(7, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, live = H._padded([rng.normal(size=(n, 7)) for n in (4, 2, 5)])
    x, y = x.astype(np.float64), (rng.random(live.shape) < 0.5).astype(np.float64)

    def loss():
        s = model.scores(x, live)
        return float(np.where(live, np.logaddexp(0, s) - y * s, 0).sum() / live.sum())

    for k, g in model.slopes(x, live, y).items():
        flat = model.p[k].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g.reshape(-1)[i]) < 2e-4, k


def article(page):
    import html

    inner = page[page.index("<article>") : page.index("</article>")]
    parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"<[^>]*>", inner)]
    return "\n".join(p for p in parts if p)


def test_extraction_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    right = sum(got[r["page_id"]]["text"] == article(r["html"]) for r in rows)
    assert right >= 0.98 * len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<div>" * 3000 + "x"), (4, "u", "<" * 5000), (5, "u", "<p>a &amp; b &lt;c&gt; &eacute;</p><!-- x --><script>var a='</p>';</script>"), (5, "u", "<p>a"), (None, "u", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert H.extract(df).count() == 7 and H.extract(df.limit(0)).count() == 0
    assert [b.text for b in H.blocks(rows[4][2])] == ["a & b <c> é"]
    assert [b.text for b in H.blocks("<p>one<br>two <b>three</b><p>four<ul><li>five<li>six</ul>")] == ["one two three", "four", "five", "six"]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a", "<a '\"", "<!", "<div>", "<p>x</q>", "<script></script "])
def test_long_odd_pages_take_time_in_proportion(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.time()
    H.blocks(page)
    H.blocks(page + '>"')
    assert time.time() - began < 20


def test_tags_after_one_that_never_ends():
    assert [b.text for b in H.blocks("<p>one</p><div title=\"x>y\">two</div><p>three <b four")] == ["one", "two", "three <b four"]
    assert [b.text for b in H.blocks("<p>a<i \"<p>b</p> c='d'")] == ["ab", "c='d'"]
    assert [b.text for b in H.blocks("<script>if (a<b) x=\"</script><p>text</p>")] == ["text"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark_dir, counts = "/root/testdata/sf0.001", [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, spark_dir), name)
        assert docs.columns == before.columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 0
    ids = docs.select("doc_id").collect()
    pieces = corpus_pipeline.run(spark, spark_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("due")).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in ids} and all(r["n"] == r["due"] for r in pieces)


def test_each_stage_equals_brute_force(spark, toxic_model, path):
    """Every stage over what the one before kept, held against its rule applied literally."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    given = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) between 200 and 1500").orderBy("doc_id").limit(120).collect()]
    shared = [" ".join(f"s{i}x{k}" for k in range(30)) for i in range(3)]
    texts = given + [t + " extra" for t in given[:15]] + given[15:20]
    texts += [f"{rng.choice(given)} {rng.choice(shared)} mail me{i % 4}@corp.com or 10.0.0.{i % 3}" for i in range(20)] + ["", None, "one two"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, docs, DIR), name)
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    model = T.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    p = lambda t: 1 / (1 + np.exp(-(model.bias + sum(model.word(w) for w in set(WORD.findall(t or ""))))))
    kept = {i: t for i, t in rows if p(t) < 0.7}
    assert after("toxicity") == kept
    kept = {i: t for i, t in kept.items() if link_literally(list(kept.items()))[i][2]}
    assert after("minhash_near_dedup") == kept
    sizes = cut_literally(list(kept.items()))
    got = after("substring_dedup")
    for i, t in kept.items():
        assert got[i] == t if not sizes[i][1] else hashlib.sha256(got[i].encode()).hexdigest() == sizes[i][2]
    assert any(n for _, n, _ in sizes.values())
    before = list(got.items())
    marks = [[(a, b, f"[{k.upper()}]") for a, _, k, b in base_spans(t)] + [(a, b, "[TERM]") for a, b in own] for (_, t), own in zip(before, term_spans(before), strict=True)]
    want = {i: None if t is None else sanitised(t, m) for (i, t), m in zip(before, marks, strict=True)}
    got = after("pii")
    assert got == want and any(marks)
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, DIR).collect()
    for i, t in got.items():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_stages_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert (docs.count() > 0) == (start is odd)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered_queries_cover_whole_tables(spark, name):
    spark_dir = "/root/testdata/sf0.001"
    rows = Q.QUERIES[name](spark, spark_dir)
    source, key = {"op5_html_extraction": ("pages", "page_id"), "op8_embedding_near_dedup": ("embeddings", "vec_id"), "op10_exact_topk": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    due = spark.read.parquet(f"{spark_dir}/{source}.parquet").select(key)
    if name == "op10_exact_topk":
        due, rows = due.where("vec_id % 50 = 0"), rows.withColumn("vec_id", F.col("query_id"))
    assert rows.select(key).distinct().count() == due.distinct().count()
