"""A graph that is kept in a store and asked by clients that take strings.

The service recovers its graph when it opens.  Queries give columns and rows of
text; those that change the graph change it for later queries and reach the store
with the next snapshot.  Records are logged as they are applied.  A thread makes
a snapshot every ``snapshot_seconds``, if anything changed.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .questions import ask
from .schema import GraphSchema
from .sources.sinks import as_strings
from .sources.store import GraphStore
from .streaming.ingest import apply_batch, log_entries, reason


@dataclass(frozen=True)
class Settings:
    """store: folder of snapshots and log; translate: from a prompt to a query, if questions are taken; most_rows: of a result that goes to a client."""

    store: str
    snapshot_seconds: float = 300
    translate: Callable[[str], str] | None = None
    most_rows: int = 10_000


@dataclass
class Result:
    """error: what went wrong; query: the one that a translator gave."""

    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    error: str = ""
    query: str = ""


class GraphService:
    def __init__(self, spark: SparkSession, schema: GraphSchema, settings: Settings):
        self.settings, self.store = settings, GraphStore(spark, settings.store, schema)
        self.graph, self.changed, self.lock = self.store.recover(), False, threading.RLock()
        self.stopped = threading.Event()
        self.timer = threading.Thread(target=self._snapshots, daemon=True)
        if settings.snapshot_seconds > 0:
            self.timer.start()

    def _snapshots(self) -> None:
        while not self.stopped.wait(self.settings.snapshot_seconds):
            self.snapshot()

    def snapshot(self) -> int | None:
        """Write a snapshot if anything changed; gives its number."""
        with self.lock:
            if not self.changed:
                return None
            number = self.store.snapshot(self.graph)
            # What follows starts from the written tables, not from the changes' plans.
            self.graph, self.changed = self.store.recover(), False
            return number

    def cypher(self, query: str) -> Result:
        with self.lock:
            try:
                graph, rows = self.graph.execute(query)
                out = self._result(rows)
            except Exception as e:  # the client gets the message
                return Result(error=str(e), query=query)
            if graph is not self.graph:
                self.graph, self.changed = graph, True
            return out

    def _result(self, rows: DataFrame) -> Result:
        return Result(rows.columns, [list(r) for r in as_strings(rows).limit(self.settings.most_rows).collect()] if rows.columns else [])

    def natural_language(self, question: str) -> Result:
        """The rows of the query that the translator makes of a question; with an error the query is given too."""
        if self.settings.translate is None:
            return Result(error="no translator is set")
        try:
            with self.lock:
                answer = ask(self.graph, question, self.settings.translate)
                if answer.error is None:
                    out = self._result(answer.rows)
                    out.query = answer.query
                    return out
        except Exception as e:
            return Result(error=str(e))
        return Result(error=str(answer.error), query=answer.query)

    def ingest(self, records: DataFrame) -> list[str]:
        """Apply records (seq, attributes, body), log them, and give the reasons of the rejected ones by seq."""
        with self.lock:
            graph, bad = apply_batch(self.graph, records)
            reasons = [r["reason"] for r in bad.orderBy("seq").select("reason").collect()]
            good = records.filter(reason(self.graph).isNull())
            low = good.agg(F.min("seq")).first()[0]
            if low is not None:
                self.store.append_records(log_entries(good), self.store.last_batch() + 1)
            self.graph, self.changed = graph, True
            return reasons

    def close(self) -> None:
        """Stop the thread and write what isn't in the store yet."""
        self.stopped.set()
        if self.timer.is_alive():
            self.timer.join()
        self.snapshot()
