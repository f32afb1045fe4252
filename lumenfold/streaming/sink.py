"""A sink that takes in every micro-batch exactly once, whatever dies between writing and committing.

A batch's rows go to a folder of their own. Then a commit, named by query and batch, is put into the log by a rename that
fails if the name is taken, and the commit names the folder. Rows count only if a commit names their folder: what a killed
driver wrote without a commit, or a second driver for a batch that is committed, is never read. A replayed batch that is
committed is computed again, for the query's state must advance, but its rows go nowhere. A query is known by the id that
its checkpoint holds, so it stays the same over restarts, and a new checkpoint is a new query.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenfold.sources.files import _filesystem, create_text
from lumenfold.streaming.scan import Rules, confirm_stream


class OnceSink:
    """Rows of streams below ``path``; several queries may write to one sink."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: write and commit; a batch that is committed is only computed."""
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        if self._exists(self._entry(query, batch_id)) or batch_id <= self._snapshot()["upto"].get(query, -1):
            batch.write.format("noop").mode("overwrite").save()
            return
        folder = f"data/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{folder}")
        self._commit(self._entry(query, batch_id), {"query": query, "batch": batch_id, "folder": folder})

    def start(self, rows: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """A running query; by default it ends when what is there has been read."""
        return rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self, schema: StructType | str) -> DataFrame:
        """The committed rows. Only the names of folders pass through the driver; see ``compact``."""
        folders = self._folders()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def compact(self, schema: StructType | str) -> None:
        """Put all committed batches into one folder, so that the log and the number of files stay small.

        A snapshot replaces the commits that it covers in one rename; before it nothing changes, and what is no longer
        named is removed after it. To be called by one process at a time; queries may go on writing meanwhile.
        """
        before, entries = self._snapshot(), self._entries()
        if not entries:
            return
        folders = [*before["folders"], *[e["folder"] for e in entries]]
        folder = f"data/{uuid.uuid4().hex}"
        self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]).write.parquet(f"{self.path}/{folder}")
        upto = dict(before["upto"])
        for e in entries:
            upto[e["query"]] = max(e["batch"], upto.get(e["query"], -1))
        self._commit(f"snapshots/{before['number'] + 1:010d}", {"number": before["number"] + 1, "upto": upto, "folders": [folder]})
        for gone in [*[self._entry(e["query"], e["batch"]) for e in entries], *folders]:
            fs, where = _filesystem(self.spark, f"{self.path}/{gone}")
            fs.delete(where, True)

    def _entry(self, query: str, batch_id: int) -> str:
        return f"commits/{query}-{batch_id:010d}"

    def _exists(self, name: str) -> bool:
        fs, where = _filesystem(self.spark, f"{self.path}/{name}")
        return fs.exists(where)

    def _commit(self, name: str, content: dict) -> None:
        """Put a whole file in place, unless there is one; the first of two writers wins and the other's rows don't count."""
        create_text(self.spark, f"{self.path}/{name}", json.dumps(content))

    def _listed(self, name: str) -> list[dict]:
        fs, where = _filesystem(self.spark, f"{self.path}/{name}")
        if not fs.exists(where):
            return []
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()]

    def _snapshot(self) -> dict:
        return max(self._listed("snapshots"), key=lambda s: s["number"], default={"number": 0, "upto": {}, "folders": []})

    def _entries(self) -> list[dict]:
        upto = self._snapshot()["upto"]
        return [e for e in self._listed("commits") if e["batch"] > upto.get(e["query"], -1)]

    def _folders(self) -> list[str]:
        return [*self._snapshot()["folders"], *[e["folder"] for e in self._entries()]]


def gated(results: DataFrame, present: Column, confidence: Column, least: float) -> DataFrame:
    """All results; one without a card, or less sure than ``least``, counts as none present. A gate of 0 lets all pass."""
    sure = F.coalesce(confidence >= least, F.lit(False)) if least > 0 else F.lit(True)
    return results.withColumn("present", F.coalesce(present, F.lit(False)) & sure)


def confirm_once(results: DataFrame, sink: OnceSink, checkpoint: str, rules: Rules = Rules(), least: float = 0.0, trigger: dict | None = None) -> StreamingQuery:
    """Recognition results (session, at_ms, seq, present, card_id, confidence), gated, confirmed, and sunk exactly once."""
    scans = gated(results, F.col("present"), F.col("confidence"), least).select("session", "at_ms", "seq", "present", "card_id")
    return sink.start(confirm_stream(scans, rules), checkpoint, trigger)
