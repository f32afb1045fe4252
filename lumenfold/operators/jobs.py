"""Work that several drivers share, and work that goes on where it stopped: claims and progress."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.files import _filesystem, create_text, read_text, write_text


class Claims:
    """Claims of items as files that can be created once only, so that of any number of claimants one wins.

    A claim, its return and its takeover are each a new turn of the item, a file named by item and turn; the last turn
    counts. With a ``lease`` (in seconds), a claim that is older counts as given up, as its owner may have died, and the
    next to claim it takes it over; ``take`` by the owner itself renews it. Clocks of claimants should agree to well
    within the lease.
    """

    def __init__(self, spark: SparkSession, root: str, lease: float | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.lease, self.clock = spark, root.rstrip("/"), lease, clock

    def _folder(self, item: str) -> str:
        return f"{self.root}/{item.encode().hex()}"

    def _last(self, item: str) -> tuple[int, str | None]:
        """The item's last turn and its owner, None if it is free again."""
        fs, where = _filesystem(self.spark, self._folder(item))
        turns = [int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()] if fs.exists(where) else []
        if not turns:
            return 0, None
        held = json.loads(read_text(self.spark, f"{self._folder(item)}/{max(turns)}"))
        expired = self.lease is not None and held["at"] + self.lease < self.clock()
        return max(turns), None if expired else held["owner"]

    def _turn(self, item: str, turn: int, owner: str | None) -> bool:
        return create_text(self.spark, f"{self._folder(item)}/{turn}", json.dumps({"owner": owner, "at": self.clock()}))

    def take(self, item: str, owner: str) -> bool:
        """Whether the item is now the owner's; false if another's claim holds, or if another was faster."""
        turn, held = self._last(item)
        renewed = held == owner and self.lease is not None
        return (held is None or renewed) and self._turn(item, turn + 1, owner)

    def owner(self, item: str) -> str | None:
        return self._last(item)[1]

    def give_back(self, item: str, owner: str) -> bool:
        """Drop a claim, after an error say; only its owner can."""
        turn, held = self._last(item)
        return held == owner and self._turn(item, turn + 1, None)

    def held(self) -> DataFrame:
        """(item) of all claims that hold, as a table."""
        fs, where = _filesystem(self.spark, self.root)
        if not fs.exists(where):
            return self.spark.createDataFrame([], "item string")
        files = self.spark.read.text(f"{self.root}/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        parts = F.split("path", "/")
        named = files.select(F.decode(F.unhex(F.element_at(parts, -2)), "UTF-8").alias("item"), F.element_at(parts, -1).cast("int").alias("turn"), F.from_json("value", "owner string, at double").alias("v"))
        last = named.groupBy("item").agg(F.max_by("v", "turn").alias("v")).where("v.owner is not null")
        return (last if self.lease is None else last.where(F.col("v.at") + self.lease >= self.clock())).select("item")

    def next(self, waiting: DataFrame, key: str, order: str, owner: str, at_once: int = 64) -> str | None:
        """The first waiting item that isn't claimed and can be, latest first; None when none is left. Lost races go on to the next."""
        while True:
            free = waiting.join(self.held().withColumnRenamed("item", "__item"), F.col(key).cast("string") == F.col("__item"), "left_anti")
            rows = free.select(key).orderBy(F.desc(order), F.desc(key)).limit(at_once).collect()
            for row in rows:
                if self.take(str(row[key]), owner):
                    return str(row[key])
            if len(rows) < at_once:
                return None


def run_resumable(spark: SparkSession, path: str, items: Iterable[str], work: Callable[[str], object], every: int = 50) -> dict[str, object]:
    """Results of ``work`` by item, kept in a JSON file after every so many items and at the end, also of a failing run.

    A later run goes on behind what the file holds; an item whose work raised isn't held, so it is tried again.
    """
    held = json.loads(read_text(spark, path) or "{}")
    new = 0

    def keep() -> None:
        write_text(spark, path, json.dumps(held, sort_keys=True))

    try:
        for item in items:
            if item in held:
                continue
            held[item] = work(item)
            new += 1
            if new % every == 0:
                keep()
    finally:
        keep()
    return held
