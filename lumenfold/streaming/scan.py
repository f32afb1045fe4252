"""Confirmation of scans: a keyed state machine over events, as a batch fold and as a stateful stream.

For each session: a hit of the current candidate adds one, and at ``fill_at`` hits confirms it; a hit of another id makes
that the candidate with one hit; a miss (no card, or a card without an id) drains the count by ``drain``, and at zero
the candidate is gone; an id confirmed less than ``cooldown_ms`` ago is ignored and leaves the candidate as it is. The
first sight of an id never confirms it. Time is event time; events of a session are taken in the order of time, then of
sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CONFIRMED = "session bigint, card_id string, at_ms bigint, seq bigint"


@dataclass(frozen=True)
class Rules:
    fill_at: int = 3
    drain: int = 1
    cooldown_ms: int = 4000


@dataclass
class ScanBucket:
    """State of one session. ``confirmed`` holds ids within their cooldown only."""

    candidate: str | None = None
    count: int = 0
    confirmed: dict[str, int] = field(default_factory=dict)

    def push(self, rules: Rules, at_ms: int, present: bool, card_id: str | None) -> str | None:
        """Take an event in; the id that it confirms, if any."""
        if not present or not card_id:
            self.count = max(0, self.count - rules.drain)
            if not self.count:
                self.candidate = None
            return None
        if card_id in self.confirmed:
            if at_ms - self.confirmed[card_id] < rules.cooldown_ms:
                return None
            del self.confirmed[card_id]
        if card_id != self.candidate:
            self.candidate, self.count = card_id, 1
            return None
        self.count += 1
        if self.count < rules.fill_at:
            return None
        self.candidate, self.count = None, 0
        self.confirmed = {k: t for k, t in self.confirmed.items() if at_ms - t < rules.cooldown_ms} | {card_id: at_ms}
        return card_id


def _fold(rows: Iterable[tuple], rules: Rules) -> Iterator[tuple]:
    """Confirmations of rows (session, at_ms, seq, present, card_id) that come session by session, in order."""
    current, bucket = object(), ScanBucket()
    for session, at_ms, seq, present, card_id in rows:
        if session != current:
            current, bucket = session, ScanBucket()
        found = bucket.push(rules, at_ms, present, card_id)
        if found:
            yield session, found, at_ms, seq


def scan_events(events: DataFrame, session: str, at: str, seq: str, present, card_id) -> DataFrame:
    """The columns that the state machine reads; times as milliseconds."""
    return events.select(F.col(session).alias("session"), F.unix_millis(F.col(at)).alias("at_ms"), F.col(seq).alias("seq"), present.alias("present"), card_id.alias("card_id"))


def confirm_batch(scans: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Confirmations of a whole table. Partitions are sorted and streamed, so a session may be of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        held = []
        schema = pa.schema([("session", pa.int64()), ("card_id", pa.string()), ("at_ms", pa.int64()), ("seq", pa.int64())])
        for found in _fold(rows, rules):
            held.append(dict(zip(schema.names, found, strict=True)))
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return scans.repartition("session").sortWithinPartitions("session", "at_ms", "seq").mapInArrow(run, CONFIRMED)


class _Processor(StatefulProcessor):
    """One session's bucket in keyed state; rules come with each event, so they may change without losing state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "candidate string, count int")
        self.confirmed = handle.getMapState("confirmed", "card_id string", "at_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.bucket.get() if self.bucket.exists() else (None, 0)
        state = ScanBucket(held[0], held[1], {k[0]: v[0] for k, v in self.confirmed.iterator()})
        before = set(state.confirmed)
        out = []
        for at_ms, seq, present, card_id, *rules in sorted((r for pdf in rows for r in pdf[["at_ms", "seq", "present", "card_id", "fill_at", "drain", "cooldown_ms"]].itertuples(index=False, name=None)), key=lambda r: r[:2]):
            found = state.push(Rules(*map(int, rules)), int(at_ms), bool(present), card_id if isinstance(card_id, str) else None)
            if found:
                out.append((key[0], found, int(at_ms), int(seq)))
        self.bucket.update((state.candidate, state.count))
        for k in before - set(state.confirmed):
            self.confirmed.removeKey((k,))
        for k, t in state.confirmed.items():
            self.confirmed.updateValue((k,), (t,))
        yield pd.DataFrame(out, columns=["session", "card_id", "at_ms", "seq"])

    def close(self) -> None:
        pass


def confirm_stream(scans: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream. Events of a session are ordered within a micro-batch; across batches, arrival counts.

    ``scans`` may carry fill_at, drain and cooldown_ms columns (from a side input) in place of ``rules``. Needs the
    RocksDB state store provider.
    """
    given = {"fill_at": rules.fill_at, "drain": rules.drain, "cooldown_ms": rules.cooldown_ms}
    filled = scans.withColumns({k: F.lit(v) for k, v in given.items() if k not in scans.columns})
    return filled.groupBy("session").transformWithStateInPandas(statefulProcessor=_Processor(), outputStructType=CONFIRMED, outputMode="Append", timeMode="None")
