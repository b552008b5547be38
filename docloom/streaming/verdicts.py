"""Conformity as a stream: the results of a document's dimensions come in any order and at any time; one verdict leaves for each document."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conformity import THRESHOLD, WEIGHTS

OUT = "doc_hash string, event string, score double, n_critical long, conforms boolean, dimensions string, missing string"


class _Verdict(StatefulProcessor):
    """State by document: the results so far, and when its time is up; after the verdict only that it was given, until that is forgotten."""

    def __init__(self, wanted: list[str], weights: dict[str, float], threshold: float, wait_ms: int, keep_ms: int) -> None:
        self.wanted, self.weights, self.threshold, self.wait_ms, self.keep_ms = wanted, weights, threshold, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "dimension string", "score double, skipped boolean, n_critical long")
        self.due = handle.getValueState("due", "at long, given boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = self.due.get()[1] if self.due.exists() else False
        first, late = None, []
        for part in rows:
            for r in part.itertuples(index=False):
                if given or r.dimension not in self.wanted:
                    late.append(r.dimension)
                    continue
                self.seen.updateValue((r.dimension,), (float(r.score), bool(r.skipped), int(r.n_critical)))
                at = int(r.ts.timestamp() * 1000)
                first = at if first is None else min(first, at)
        if late:
            yield self._row(key, "conformity.late" if given else "conformity.unknown", None, None, None, sorted(late), [])
        if first is not None and not self.due.exists():
            self.due.update((first + self.wait_ms, False))
            self.handle.registerTimer(first + self.wait_ms)
        if not given and all(self.seen.containsKey((d,)) for d in self.wanted):
            yield self._verdict(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.due.exists() and not self.due.get()[1]:
            yield self._verdict(key)
        else:
            self.due.clear()

    def _verdict(self, key: Any) -> pd.DataFrame:
        results = {k[0]: v for k, v in self.seen.iterator()}
        weight = sum(self.weights.get(d, 0.0) for d in results)
        score = round(sum(self.weights.get(d, 0.0) * v[0] for d, v in results.items()) / weight, 4) if weight else 0.0
        critical = sum(v[2] for v in results.values()) + (not any(not v[1] for v in results.values()))
        at = self.due.get()[0]
        self.handle.deleteTimer(at)
        self.seen.clear()
        self.due.update((at + self.keep_ms, True))
        self.handle.registerTimer(at + self.keep_ms)
        return self._row(key, "conformity.verdict", score, critical, score >= self.threshold and critical == 0, sorted(results), [d for d in self.wanted if d not in results])

    @staticmethod
    def _row(key: Any, event: str, score: float | None, critical: int | None, conforms: bool | None, dimensions: list[str], missing: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"doc_hash": [key[0]], "event": [event], "score": pd.array([score], "Float64"), "n_critical": pd.array([critical], "Int64"), "conforms": pd.array([conforms], "boolean"),
                             "dimensions": [",".join(dimensions)], "missing": [",".join(missing)]})

    def close(self) -> None:
        pass


def verdict_stream(results: DataFrame, dimensions: list[str], weights: dict[str, float] | None = None, threshold: float = THRESHOLD, wait: int = 3600, keep: int = 86400, late: str = "10 minutes") -> DataFrame:
    """results: a stream of doc_hash, dimension, score, skipped, n_critical, ts. OUT: one verdict a document, as soon as all dimensions are in, or with what there is when the watermark
    passes `wait` seconds after the earliest row of its first batch.

    A dimension that comes again before that replaces its result. What comes after the verdict gives an event conformity.late and changes nothing; the document is forgotten `keep`
    seconds later. Other dimensions than those asked for give conformity.unknown. The session's state store must be RocksDB's provider."""
    kept = results.select("doc_hash", "dimension", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("skipped", F.lit(False)).alias("skipped"), F.coalesce("n_critical", F.lit(0)).cast("long").alias("n_critical"), "ts")
    one = _Verdict(list(dimensions), weights or WEIGHTS, threshold, wait * 1000, keep * 1000)
    return kept.withWatermark("ts", late).groupBy("doc_hash").transformWithStateInPandas(one, OUT, "append", "EventTime")


def dimension_events(results: DataFrame) -> DataFrame:
    """An audit event for each dimension's result, on streams and tables alike."""
    return results.select("ts", F.lit("conformity.dimension").alias("event"), "doc_hash", "dimension", F.to_json(F.struct("score", "skipped", "n_critical")).alias("extra"))
