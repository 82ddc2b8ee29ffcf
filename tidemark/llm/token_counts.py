"""Token counts of every prefix of a text, for truncation and budgets without encoding again.

The text falls into units, a run of white space with the run of other characters behind it.  No piece of the
tokenizer's own split reaches from the end of a unit into the next, so counts of units add up.  Within a unit a
table over its prefixes holds the exact number of tokens of each.

Cases: a null or empty text has no tokens; equal texts get equal counts; very long texts and very long runs
without white space take linear time; an empty table gives an empty table; only ``doc_id`` and ``text`` are read,
so other columns and their names don't matter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.bpe import Merges
from tidemark.llm.textutil import Remembered, arrow_map, texts_of

#: The byte-level alphabet keeps these bytes as they are, the others follow from 256 on in byte order.
PLAIN_BYTES = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Fixed value: how the byte-level tokenizer splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space as the split above takes it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixCounter:
    """Exact token counts of all prefixes for a byte-level ``tokenizers`` file."""

    def __init__(self, path: str, remember: int = 600_000) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["model"]["merges"])}
        self.merges = Merges(list(model["model"]["vocab"]), lambda a, b: ranks.get((a, b)))
        plain = set(PLAIN_BYTES)
        rest = iter(range(256, 512))
        self.symbol = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.units = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.lead = regex.compile(rf"[{SPACE}]*")
        self.remember = remember
        self._pieces: dict[str, list[int]] = {}
        self._units = Remembered(self.unit, remember)

    def piece(self, text: str) -> list[int]:
        """Counts after each character of one piece of the split; entry 0 is 0.  Prefixes end at whole characters."""
        known = self._pieces.get(text)
        if known is None:
            raw = text.encode("utf-8", "surrogatepass")
            known = self.merges.prefixes(raw.decode("latin-1").translate(self.symbol))
            if len(raw) > len(text):  # only prefixes that end at whole characters count
                known = [known[0], *(known[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80)]
            if len(text) <= 64:
                if len(self._pieces) >= self.remember // 5:
                    self._pieces.clear()
                self._pieces[text] = known
        return known

    def ordinary(self, text: str) -> list[int]:
        """Counts after each character of a text without special strings."""
        out, total = [0], 0
        for m in self.pieces.finditer(text):
            part = m.group()
            counts = self.piece(part)
            if part[0] == "'" and len(part) > 2 and part[1].isalpha():  # a cut 're, 've or 'll is an apostrophe and a letter
                counts = [0, 1, 2, *counts[3:]]
            out.extend(total + c for c in counts[1:])
            total += counts[-1]
        space = self.lead.match(text).end()
        if space > 1:  # a prefix that ends in the white space has all of it in one piece
            out[: space + 1] = self.piece(text[:space])
        return out

    def table(self, text: str) -> list[int]:
        """Number of tokens of each prefix of ``text`` by characters, special strings counting once complete."""
        out = [0]
        for m in self.units.finditer(text):
            total, unit, at = out[-1], m.group(), 0
            if self.special_at is not None:
                for s in self.special_at.finditer(unit):
                    part = self.ordinary(unit[at : s.end()])
                    before = self.ordinary(unit[at : s.start()])[-1]
                    out.extend(total + c for c in part[1:-1])
                    total += before + 1
                    out.append(total)
                    at = s.end()
            out.extend(total + c for c in self.ordinary(unit[at:])[1:])
        return out

    def unit(self, text: str) -> int:
        if self.special_at is not None and self.special_at.search(text):
            return self.table(text)[-1]
        return sum(self.piece(p)[-1] for p in self.pieces.findall(text))

    def count(self, text: str) -> int:
        return sum(map(self._units.__getitem__, self.units.findall(text)))

    def cut(self, text: str, budget: int) -> int:
        """Length in characters of the longest prefix of at most ``budget`` tokens."""
        total, at, best = 0, 0, 0
        for m in self.units.finditer(text):
            unit = m.group()
            if total > budget + 2:  # a longer prefix can save a token only inside the unit it ends in
                break
            counts = self.table(unit)
            fit = [i for i, c in enumerate(counts) if total + c <= budget]
            if fit:
                best = max(best, at + fit[-1])
            total += counts[-1]
            at += len(unit)
        return best


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text, null texts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        model = counter(path)
        tokens = [model.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and prefix_tokens: entry i is the number of tokens of the first i characters.  Store it to answer budget questions later."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = counter(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.table(t) for t in texts_of(batch.column(1))], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, prefix_tokens array<int>", rows=32)


def truncate_texts(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id, text cut to its longest prefix of at most ``budget`` tokens, and the characters kept; a null text stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = counter(path)
        texts = batch.column(1).to_pylist()
        cuts = [0 if t is None else model.cut(t, budget) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if t is None else t[:n] for t, n in zip(texts, cuts, strict=True)], pa.string()), pa.array(cuts, pa.int64())], ["doc_id", "text", "n_kept"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, text string, n_kept long")
