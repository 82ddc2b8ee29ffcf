"""Encoding and decoding with a sentencepiece model of the merge type, exactly as its library does.

The text gets a space in front, spaces become the model's mark, and it falls into units: marks with the run of
other characters behind them.  No piece holds a mark behind another character, so no merge reaches into the next
unit.  Each unit is encoded by backtracking over longest matches (``Merges.encode``); a character that is no piece
becomes its bytes.

Cases: a null or empty text has no ids and decodes to the empty text; equal texts get equal ids; very long texts
and runs without spaces take linear time; an empty table gives an empty table; only ``doc_id`` and ``text`` are
read, so other columns and their names don't matter.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import Merges
from tidemark.llm.textutil import Remembered, arrow_map, texts_of

MARK = "▁"
codecs.register_error("replace-each", lambda e: ("\ufffd", e.start + 1))
#: The kinds of a piece in the model's file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceCodec:
    def __init__(self, path: str, remember: int = 1_300_000) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or any(MARK in p.piece.lstrip(MARK) for _, p in normal):
            raise ValueError("only merge-type models without a normalizer and with marks in front are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        cost = {p.piece: -p.score for _, p in normal}
        self.merges = Merges([p.piece for _, p in normal], lambda a, b: cost.get(a + b))
        self.id_of = [i for i, _ in normal]
        self.byte_id = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.shown = [p.piece.replace(MARK, " ") if p.type == NORMAL else "" if p.type == CONTROL else " ⁇ " for p in model.pieces]
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.spaced = {i for i, p in normal if p.piece.startswith(MARK)}
        self.units = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
        self._units = Remembered(self.unit, remember)

    def unit(self, text: str) -> str | tuple[str, str]:
        """Ids of a unit in decimal, joined by commas, and the text that they decode to where it isn't the unit's own."""
        ids: list[int] = []
        at, known_chars = 0, self.merges.ids
        for i, c in enumerate(text):
            if c not in known_chars:
                ids += [self.id_of[t] for t in self.merges.encode(text[at:i])]
                ids += [self.byte_id[b] for b in c.encode("utf-8")] if self.byte_id else [self.unknown]
                at = i + 1
        ids += [self.id_of[t] for t in self.merges.encode(text[at:] if at else text)]
        shown, joined = self.text(ids), ",".join(map(str, ids))
        return joined if shown == text.replace(MARK, " ") else (joined, shown)

    def both(self, text: str) -> tuple[str, str]:
        """All ids in decimal, joined by commas, and the text that they decode to.

        No character reaches over units, so both follow from those of the units in turn.
        """
        if not text:
            return "", ""
        units = self.units.findall(self.prefix + text.replace(" ", MARK))
        parts = list(map(self._units.__getitem__, units))
        try:
            joined, shown = ",".join(parts), "".join(units).replace(MARK, " ")
        except TypeError:  # some unit decodes to another text
            joined = ",".join(p if isinstance(p, str) else p[0] for p in parts)
            shown = "".join(u.replace(MARK, " ") if isinstance(p, str) else p[1] for u, p in zip(units, parts, strict=True))
        return joined, self.trimmed(shown)

    def encode(self, text: str) -> list[int]:
        joined = self.both(text)[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined, marks as spaces, without the space in front; runs of bytes as UTF-8, a replacement for each byte that fits nowhere."""
        ids = list(ids)
        first = next((i for i in ids if i not in self.controls), None)
        text = self.text(ids)
        return self.trimmed(text) if first in self.spaced else text

    def trimmed(self, text: str) -> str:
        return text[1:] if self.prefix and text.startswith(" ") else text

    def text(self, ids: list[int]) -> str:
        if not self.byte_of.keys().isdisjoint(ids):
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace-each"))
                    run.clear()
                out.append(self.shown[i])
            return "".join(out) + run.decode("utf-8", "replace-each")
        return "".join(map(self.shown.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text, without begin or end ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.encode(t) for t in texts_of(batch.column(1))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>", rows=64)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give the empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string", rows=64)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding of every whole text in one pass, as digests."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = codec(path)
        sizes, of_ids, of_text = [], [], []
        for text in texts_of(batch.column(1)):
            joined, shown = model.both(text)
            sizes.append(joined.count(",") + 1 if joined else 0)
            of_ids.append(_digest(joined))
            of_text.append(_digest(shown))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=128)
