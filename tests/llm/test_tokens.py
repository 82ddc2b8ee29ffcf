"""Packing, sentence pieces and token counts against the libraries and a round trip."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm.packing import SumOfSquares, WordTable, WordTokens, pack
from tidemark.llm.sentence_pieces import PieceCodec, decode_ids, encode_digests, encode_texts
from tidemark.llm.token_counts import PrefixCounter, count_tokens, prefix_tables, truncate_texts

ALPHABET = "abt' \n\t é漢🙂1.<|endoftext|>sSreLl▁  "


def odd_texts(n, seed, extra=""):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET + extra) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["<|endoftext|> a<|endoftext|>", " " * 40 + "the", "ab" * 3000, "the" * 2000, "\x00\x7f", "'ll've're", "don't 'RE"]


def test_prefix_tables_equal_the_library_at_every_prefix(path):
    own, lib = PrefixCounter(path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    for t in odd_texts(150, 1):
        short = t[:60]
        assert own.table(short) == [len(lib.encode(short[:i], add_special_tokens=False).ids) for i in range(len(short) + 1)]
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_truncation_is_the_longest_that_fits(path):
    own = PrefixCounter(path("byte_bpe_50k.json"))
    for t in odd_texts(80, 2):
        t = t[:80]
        table = own.table(t)
        for budget in (0, 1, 3, 10, 1000):
            assert own.cut(t, budget) == max(i for i, c in enumerate(table) if c <= budget)


def test_pieces_equal_the_library(path):
    own, lib = PieceCodec(path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    for t in odd_texts(1500, 3):
        ids = lib.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)
    for ids in ([], [1, 2], [5, 200, 3], [229, 187], [29871, 29871], [0, 1, 300, 0]):
        assert own.decode(ids) == lib.decode(ids)


def test_words_equal_the_library(path):
    own, lib = WordTokens(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = odd_texts(1500, 4, "ΣİǺ̇ßÉéÀ×÷") + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCéÉß019.,-'") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    flat, ends = own.ids(pa.array([*texts, None]))
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert ends[-1] == ends[-2]


def test_words_that_are_forgotten_or_clash(path):
    own, few = WordTokens(path("word_bpe_49k.json")), WordTokens(path("word_bpe_49k.json"), remember=50)
    texts = [f"word{i % 700} x{i} café" for i in range(2000)]
    want = own.ids(pa.array(texts))
    got = [few.ids(pa.array(texts[i : i + 100])) for i in range(0, 2000, 100)]
    assert np.concatenate([g[0] for g in got]).tolist() == want[0].tolist()
    table = WordTable(np.uint16)
    key, check = np.array([5, 5, 1 << 16 | 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    table.add(key, check, np.array([1, 2, 0, 1]), np.array([9, 8, 7, 6]))
    assert table.find(key, check).tolist() == [0, 1, 2, 3] and table.find(key, check + np.uint32(5)).tolist() == [-1] * 4


@pytest.mark.parametrize("lengths", [[2049] * 400, [1] * 500, [4095, 1] * 100, list(range(1, 600))])
def test_windows_hold_every_id_once(lengths):
    packer, done = SumOfSquares(4096, most_open=50), []
    for i, n in enumerate(lengths):
        done += packer.place((i, 0, np.arange(n, dtype=np.uint32), n))
    done += packer.drain(last=True)
    seen = defaultdict(list)
    for w in done:
        assert sum(len(p[2]) for p in w) <= 4096
        for doc, start, ids, _ in w:
            assert ids.tolist() == list(range(start, start + len(ids)))
            seen[doc].append((start, len(ids)))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == n
    assert sum(sum(len(p[2]) for p in w) < 4096 for w in done) <= 1


def check_packed(rows, texts, path):
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for doc, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        pieces, at = sorted(by_doc[doc], key=lambda r: r["start"]), 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for w in by_window.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_packing_a_table(docs, path):
    rows = pack(docs, path("word_bpe_49k.json"), with_ids=True).collect()
    assert all(r["length"] == len(r["ids"]) for r in rows)
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], path)


def test_odd_rows(odd, none, path):
    unique = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (9, None)]
    check_packed([r for r in pack(odd, path("word_bpe_49k.json")).collect() if r["doc_id"] not in (9, None)], unique, path)
    assert encode_digests(odd, path("piece_bpe_32k.model")).count() == count_tokens(odd, path("byte_bpe_50k.json")).count() == 11
    lib = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    for r in encode_digests(odd, path("piece_bpe_32k.model")).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = lib.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    for df in (pack(none, path("word_bpe_49k.json")), encode_digests(none, path("piece_bpe_32k.model")), count_tokens(none, path("byte_bpe_50k.json")), prefix_tables(none, path("byte_bpe_50k.json"))):
        assert df.count() == 0


def test_columns_of_ids_and_texts(odd, path):
    back = decode_ids(encode_texts(odd, path("piece_bpe_32k.model")), path("piece_bpe_32k.model")).join(odd.select("doc_id", "text").distinct().withColumnRenamed("text", "old"), "doc_id")
    assert all(r["text"] == (r["old"] or "") for r in back.collect())
    cut = {r["doc_id"]: r for r in truncate_texts(odd, path("byte_bpe_50k.json"), 2).collect()}
    assert cut[1]["text"] is None and cut[4]["text"] == "one two" and cut[7]["text"] == "w0"
