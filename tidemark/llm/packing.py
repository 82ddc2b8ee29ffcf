"""Sum-of-squares packing of tokenised documents into sequences of fixed size.

Each task keeps the number of its open windows at every fill level.  A document's ids, cut where they are longer
than a window, go to the level whose choice makes the sum of the squared counts smallest (equal: the fullest).
Windows that are full leave at once.  When too many are open, and at the end, the emptiest are cut up to fill the
others, so that at most one partly filled window of a task remains.  Nothing is shuffled.

Cases: a null or empty text is a document with the end id alone; a null doc_id stays null; texts longer than a
window are cut into as many pieces as they need; repeated rows are separate documents; an empty table gives an
empty table; only ``doc_id`` and ``text`` are read, so other columns and their names don't matter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.substring_dedup import Hashes
from tidemark.llm.textutil import FORGET, SLICE_ROWS, crc_of, mix64, release, small_batches, words_as_bytes

#: (document, start in it, ids, tokens of the document)
Piece = tuple["int | None", int, np.ndarray, int]
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Pieces up to so many bytes are merged here; the rank of a pair that doesn't merge.
LONGEST, NEVER = 24, np.iinfo(np.int32).max
LETTER, DIGIT, SIGN, FOREIGN = range(4)
#: Classes of bytes.  Apostrophes and what special strings begin with are left to the library, as is what isn't ASCII.
CLASS = np.full(256, FOREIGN, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[[ord(c) for c in "'<"]] = FOREIGN
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


def byte_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits, never zero, and 32 bits of each run of bytes."""
    values = mix64(np.arange(256, dtype=np.uint64))[data]
    key = Hashes(values).of(ends[:-1], ends[1:])
    check = Hashes(values, 0xD1342543DE82EF95).of(ends[:-1], ends[1:])
    return key | (key == 0), (check >> np.uint64(32)).astype(np.uint32)


class WordTable:
    """Ids of words by two hashes of them, in arrays: an open-addressed table, about 50 bytes a word."""

    def __init__(self, kind: type) -> None:
        self.bits, self.n, self.used = 16, 0, 0
        self.key, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.check, self.size, self.start = np.zeros(1 << 15, np.uint32), np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int64)
        self.flat = np.zeros(1 << 17, kind)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 where it isn't known."""
        out = np.full(len(key), -1, np.int64)
        mask = np.uint64((1 << self.bits) - 1)
        left, at = np.arange(len(key)), key & mask
        while len(left):
            there, slot = self.key[at], self.slot[at]
            hit = (there == key[left]) & (self.check[slot] == check[left])
            out[left[hit]] = slot[hit]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + np.uint64(1)) & mask
        return out

    def _place(self, key: np.ndarray, slot: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        left, at = np.arange(len(key)), key & mask
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = key[left[free]]
            self.slot[at[free]] = slot[left[free]]
            go = (self.key[at] != key[left]) | (self.slot[at] != slot[left])  # of several for one place the last has it
            left, at = left[go], (at[go] + np.uint64(1)) & mask

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """New words, the ids of each behind those of the one before."""
        while self.n + len(key) > len(self.size):
            self.check, self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.check, self.size, self.start))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.n, self.n + len(key))
        self.check[own], self.size[own], self.start[own] = check, size, self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        if 2 * (self.n + len(key)) > 1 << self.bits:
            old, slots = self.key, self.slot
            while 2 * (self.n + len(key)) > 1 << self.bits:
                self.bits += 1
            self.key, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old[old != 0], slots[old != 0])
        self._place(key, np.arange(self.n, self.n + len(key), dtype=np.int32))
        self.n, self.used = self.n + len(key), self.used + len(flat)


class WordTokens:
    """Ids of texts by a ``tokenizers`` file whose pieces never hold white space, so that words can be remembered.

    Words of ASCII and the letters U+00C0 to U+00FF are cut into pieces and merged here, many words at once; all
    others, and pieces longer than ``LONGEST`` bytes, go to the library.
    """

    def __init__(self, path: str, remember: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.remember = Tokenizer.from_file(path), remember
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], spec["end_of_word_suffix"]
        self.kind = np.uint16 if max(self.model.get_vocab().values()) < 1 << 16 else np.uint32
        chars = _byte_chars()
        self.first, self.last = (np.array([vocab[c + e] for c in chars], np.int32) for e in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Ranks of pairs in an open-addressed table: places by a multiplied key.
        self.bits = 2 + len(pairs).bit_length()
        self.pair, self.rank = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NEVER, np.int32)
        key = (left << np.uint64(32) | right) + np.uint64(1)
        todo, at = np.arange(len(key)), self._spot(key)
        while len(todo):
            free = self.pair[at] == 0
            self.pair[at[free]], self.rank[at[free]] = key[todo[free]], todo[free]
            go = self.pair[at] != key[todo]
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        self.forget()

    def forget(self) -> None:
        self.table = WordTable(self.kind)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NEVER where they don't merge."""
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1)
        at = self._spot(key)
        there = self.pair[at]
        out = np.where(there == key, self.rank[at], NEVER)
        left_over = np.flatnonzero((there != key) & (there != 0))
        at = at[left_over]
        while len(left_over):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.pair[at]
            hit = there == key[left_over]
            out[left_over[hit]] = self.rank[at[hit]]
            go = ~hit & (there != 0)
            left_over, at = left_over[go], at[go]
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one to LONGEST bytes, padded by -1, and how many each has: the best pair first, the leftmost of equals."""
        ids, count = np.full((len(start), LONGEST), -1, np.int32), size.astype(np.int32).copy()
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(1, LONGEST + 2))
        for n in range(1, LONGEST + 1):
            rows = order[cuts[n - 1] : cuts[n]]
            if not len(rows):
                continue
            s = self.first[data[start[rows][:, None] + np.arange(n)]]
            s[:, -1] = self.last[data[start[rows] + n - 1]]
            r = self.ranks(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(rows), n - 1)
            for width in range(n, 1, -1):
                k = r.argmin(1)
                best = r[np.arange(len(r)), k]
                stop = best == NEVER
                if stop.any():
                    ids[rows[stop], :width], count[rows[stop]] = s[stop], width
                    rows, s, r, k, best = rows[~stop], s[~stop], r[~stop], k[~stop], best[~stop]
                    if not len(rows):
                        break
                row = np.arange(len(rows))
                s[row, k + 1] = self.made[best]
                keep = np.ones(s.shape, bool)
                keep[row, k] = False
                s = s[keep].reshape(-1, width - 1)
                keep = keep[:, :-1]
                if width > 2:
                    r = r[keep].reshape(-1, width - 2)
                    inner = np.flatnonzero(k > 0)
                    r[inner, k[inner] - 1] = self.ranks(s[inner, k[inner] - 1], s[inner, k[inner]])
                    inner = np.flatnonzero(k < width - 2)
                    r[inner, k[inner]] = self.ranks(s[inner, k[inner]], s[inner, k[inner] + 1])
                else:
                    r = r[:, :0]
            if len(rows):
                ids[rows, :1], count[rows] = s[:, :1], 1
        return ids, count

    def learn(self, data: np.ndarray, ends: np.ndarray, which: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Learns the words ``which`` of those that ``ends`` cuts ``data`` into."""
        size = np.diff(ends)[which]
        word = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        own = data[np.repeat(ends[:-1][which], size) + at]
        kind = CLASS[own]
        lead = np.zeros(len(own), bool)  # of two bytes that are one letter
        lead[:-1] = (own[:-1] == 0xC3) & (own[1:] >= 0x80) & (own[1:] < 0xC0) & (own[1:] != 0x97) & (own[1:] != 0xB7)
        tail = np.zeros(len(own), bool)
        tail[1:] = lead[:-1]
        kind[lead | tail] = LETTER
        lower = own + 32 * ((own >= 65) & (own <= 90) | tail & (own < 0x9F)).astype(np.uint8)
        cut = np.ones(len(own), bool)
        cut[1:] = (at[1:] == 0) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(own))
        odd = np.zeros(len(which), bool)
        odd[word[kind == FOREIGN]] = True
        odd[word[starts[lengths > LONGEST]]] = True
        use = ~odd[word[starts]]
        starts, lengths = starts[use], lengths[use]
        ids, count = self.merged(lower, starts, lengths)
        plain = np.flatnonzero(~odd)
        per_word = np.bincount(word[starts], count, len(which)).astype(np.int64)[plain]
        self.table.add(key[which[plain]], check[which[plain]], per_word, ids[np.arange(LONGEST) < count[:, None]])
        odd_ones = which[odd]
        for lo in range(0, len(odd_ones), 4096):
            part = odd_ones[lo : lo + 4096]
            texts = [data[ends[i] : ends[i + 1]].tobytes().decode("utf-8") for i in part]
            each = [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            self.table.add(key[part], check[part], np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text starts and the last ends."""
        data, ends, codes, offsets = words_as_bytes(column)
        key, check = byte_hashes(data, ends)
        if self.table.n + len(key) > self.remember:
            self.forget()
        slots = self.table.find(key, check)
        if len(new := np.flatnonzero(slots < 0)):
            for lo in range(0, len(new), 1 << 15):
                self.learn(data, ends, new[lo : lo + (1 << 15)], key, check)
            slots[new] = self.table.find(key[new], check[new])
        sizes = self.table.size[slots][codes]
        out = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at = np.repeat(self.table.start[slots][codes] - out[:-1], sizes) + np.arange(out[-1])
        return self.table.flat[at].astype(np.uint32), out[offsets]


@lru_cache(maxsize=1)
def tokens_of(path: str, remember: int) -> WordTokens:
    return WordTokens(path, remember)


FORGET.append(tokens_of.cache_clear)


class SumOfSquares:
    """Open windows of one task by fill level; ``place`` and ``drain`` give the windows that are done."""

    def __init__(self, size: int, most_open: int = 512) -> None:
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        n = len(piece[2])
        if n >= self.size:
            return [[piece]]
        cost = 1 - 2 * self.count[: self.size - n + 1]
        cost[self.count[: self.size - n + 1] == 0] = np.iinfo(np.int64).max // 2
        cost[0] = 0
        after = 2 * self.count[n : self.size + 1] + 1
        after[-1] = 0
        cost += after
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        window: list[Piece] = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + n == self.size:
            return [window]
        self.open.setdefault(level + n, []).append(window)
        self.count[level + n] += 1
        self.n_open += 1
        return self.drain() if self.n_open > self.most_open else []

    def drain(self, last: bool = False) -> list[list[Piece]]:
        """Cuts the emptiest windows to fill the fullest; the one that stays partly filled is given only at last."""
        order = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        done: list[list[Piece]] = []
        self.count[:] = 0
        self.open, self.n_open = {}, 0
        lo, hi = 0, len(order) - 1
        fill = [sum(len(p[2]) for p in w) for w in order]
        while lo <= hi:
            while fill[lo] < self.size and lo < hi:
                doc, start, ids, total = order[hi].pop()
                n = min(len(ids), self.size - fill[lo])
                order[lo].append((doc, start, ids[:n], total))
                fill[lo] += n
                fill[hi] -= n
                if n < len(ids):
                    order[hi].append((doc, start + n, ids[n:], total))
                elif not order[hi]:
                    hi -= 1
            if fill[lo] == self.size or last:
                done.append(order[lo])
            else:
                self.open[fill[lo]] = [order[lo]]
                self.count[fill[lo]] = self.n_open = 1
            lo += 1
        return done


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, with_ids: bool = False, remember: int = 1_500_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is its text's ids and then ``end_id``.  ``sequence_id`` holds the task's number and a count within it.
    ``remember`` bounds the words whose ids a worker keeps, about 50 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokens_of(path, remember), SumOfSquares(size)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        made = 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for window in windows:
                at = 0
                for doc, start, part, total in window:
                    out.append((doc, start, len(part), crc_of(part), total, base + made, at))
                    at += len(part)
                    if with_ids:
                        ids.append(part)
                made += 1
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names)

        end = np.array([end_id], np.uint32)
        for big in batches:
            for at in range(0, big.num_rows, 4 * SLICE_ROWS):
                batch = big.slice(at, 4 * SLICE_ROWS)
                flat, ends = tokens.ids(batch.column(1))
                done: list[list[Piece]] = []
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    ids = np.concatenate([flat[ends[i] : ends[i + 1]], end])
                    for start in range(0, len(ids), size):
                        done += packer.place((doc, start, ids[start : start + size], len(ids)))
                if done:
                    yield rows(done)
        if done := packer.drain(last=True):
            yield rows(done)
        release()

    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS + (", ids array<int>" if with_ids else ""))
