"""Features declared as text: point-in-time measures over a transaction and a chargeback stream.

A line of a declaration names a group of events, a stream, a measure with the value it is taken of, and windows:

    card | txn | sum amount | 1h 24h 7d

What a measure needs and means stands in ``MEASURES``, to which ``register`` adds further ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Window lengths in microseconds; "all" is all of the past.
SPANS: dict[str, int | None] = {"1h": HOUR, "24h": 24 * HOUR, "7d": 7 * 24 * HOUR, "30d": 30 * 24 * HOUR, "all": None}
#: Groups of events and the columns that hold their keys.
GROUPS: dict[str, tuple[str, ...]] = {"card": ("card_id",), "card_category": ("card_id", "category"), "merchant": ("merchant_id",), "category": ("category",), "global": ()}
#: Values and the columns that hold them.
VALUES = {"amount": "cents", "merchant": "merchant_id", "category": "category"}
STREAMS = ("txn", "cb")


class Measure(NamedTuple):
    """How a measure is made.

    ``sums`` are the powers of the value whose running sums make it (0: number of events, 1: sum, 2: sum of squares),
    from which ``column`` makes it in a plan and ``number`` in the state of a stream; sums of squares are decimal in
    a plan.  A measure without sums has a way of its own, named by ``way``: largest, variety, latest or earliest.
    """

    sums: tuple[int, ...] = ()
    column: Callable[..., Column] | None = None
    number: Callable[..., float | None] | None = None
    way: str = ""
    of_value: bool = True
    windows: bool = True
    whole_past: bool = True
    streams: tuple[str, ...] = ("txn",)


def _spread(n: Column, s: Column, q: Column) -> Column:
    wide = n.cast("decimal(12,0)") * q - s.cast("decimal(18,0)") * s.cast("decimal(18,0)")
    return F.when(n > 0, F.sqrt(F.greatest(wide.cast("double"), F.lit(0.0))) / n / 100.0)


MEASURES: dict[str, Measure] = {
    "count": Measure((0,), lambda n: n.cast("bigint"), float, of_value=False, streams=STREAMS),
    "sum": Measure((1,), lambda s: s / F.lit(100.0), lambda s: s / 100),
    "mean": Measure((0, 1), lambda n, s: F.when(n > 0, s / n / 100.0), lambda n, s: s / n / 100 if n else None),
    "std": Measure((0, 1, 2), _spread, lambda n, s, q: max(n * q - s * s, 0) ** 0.5 / n / 100 if n else None),
    "max": Measure(way="largest", whole_past=False),
    "distinct": Measure(way="variety", whole_past=False),
    "since_last": Measure(way="latest", of_value=False, windows=False, streams=STREAMS),
    "since_first": Measure(way="earliest", of_value=False, windows=False),
}


def register(name: str, measure: Measure) -> None:
    """Adds a measure made of running sums; plans and streams know it from then on."""
    if name in MEASURES or not name.isidentifier() or not (measure.sums and measure.column and measure.number) or set(measure.sums) - {0, 1, 2}:
        raise ValueError(f"{name!r} is taken, not a name, or not made of sums")
    MEASURES[name] = measure


class Feature(NamedTuple):
    name: str
    group: str
    stream: str
    measure: str
    value: str | None
    window: str

    @property
    def keys(self) -> tuple[str, ...]:
        return GROUPS[self.group]

    @property
    def span(self) -> int | None:
        return SPANS[self.window]

    @property
    def how(self) -> Measure:
        return MEASURES[self.measure]

    @property
    def column(self) -> str | None:
        return VALUES[self.value] if self.value else None


def _line(line: str) -> Iterator[Feature]:
    """The features of one line; raises ValueError with what is wrong with it."""
    fields = [f.split() for f in line.split("|")]
    if len(fields) not in (3, 4) or any(len(f) != 1 for f in fields[:2]) or len(fields[2]) not in (1, 2):
        raise ValueError(f"not 'group | stream | measure value | windows': {line!r}")
    (group,), (stream,), (measure, *value), windows = *fields[:3], (fields[3] if len(fields) == 4 else ["all"])
    for known, name in ((GROUPS, group), (STREAMS, stream), (MEASURES, measure), *((VALUES, v) for v in value), *((SPANS, w) for w in windows)):
        if name not in known:
            raise ValueError(f"{name!r} is none of {', '.join(known)}: {line!r}")
    how = MEASURES[measure]
    for bad, why in (
        (stream not in how.streams, f"{measure} isn't taken of {stream}"),
        (how.of_value != bool(value), f"{measure} is taken of {'a value' if how.of_value else 'no value'}"),
        (measure not in ("distinct",) and bool(value) and value != ["amount"], f"{measure} is taken of amounts"),
        (not how.windows and len(fields) == 4, f"{measure} looks at all of the past"),
        (not how.whole_past and "all" in windows, f"{measure} needs windows"),
    ):
        if bad:
            raise ValueError(f"{why}: {line!r}")
    for w in windows:
        parts = [*(["cb"] if stream == "cb" else []), measure, *value, *([w] if how.windows else [])]
        yield Feature(f"{group}__{'_'.join(parts)}", group, stream, measure, value[0] if value else None, w)


class Catalog(Mapping[str, Feature]):
    """Features by name, in the order of their declaration."""

    def __init__(self, features: Iterable[Feature]) -> None:
        self._by_name: dict[str, Feature] = {}
        for f in features:
            if self._by_name.setdefault(f.name, f) is not f:
                raise ValueError(f"{f.name} is declared twice")

    @classmethod
    def parse(cls, text: str) -> Catalog:
        return cls(f for line in text.strip().splitlines() if line.strip() for f in _line(line))

    def __getitem__(self, name: str) -> Feature:
        return self._by_name[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._by_name)

    def __len__(self) -> int:
        return len(self._by_name)

    def pick(self, names: Iterable[str]) -> Catalog:
        wanted = set(names)
        return Catalog(f for f in self.values() if f.name in wanted)

    def of_group(self, *groups: str) -> list[str]:
        return [f.name for f in self.values() if f.group in groups]

    @property
    def fingerprint(self) -> str:
        """Changes whenever what is declared changes, whatever the order."""
        said = {f.name: [f.group, f.stream, f.measure, f.value, f.window] for f in self.values()}
        return hashlib.blake2b(json.dumps(said, sort_keys=True).encode(), digest_size=8).hexdigest()


#: The features that models use.
CARD_RISK = Catalog.parse("""
    card          | txn | count             | 1h 24h 7d
    card          | txn | sum amount        | 1h 24h 7d
    card          | txn | max amount        | 24h 7d
    card          | txn | distinct merchant | 24h
    card          | txn | distinct category | 24h
    card          | txn | since_last
    card          | txn | count             | all
    card          | txn | mean amount       | all
    card          | txn | std amount        | all
    card          | txn | since_first
    card_category | txn | count             | all 7d
    card_category | txn | mean amount       | all
    merchant      | txn | count             | 30d
    merchant      | cb  | count             | 30d
    category      | txn | count             | 30d
    category      | cb  | count             | 30d
    global        | txn | count             | 30d
    global        | cb  | count             | 30d
    card          | cb  | count             | all
    card          | cb  | since_last
""")
