"""Observability: a log of file skipping and of commits, kept in the session."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

PUSHDOWN = (
    "query_string string, filter_type string, files_before bigint, files_after bigint, "
    "filters_before array<string>, filters_after array<string>, path string"
)
RECORDS = "timestamp double, type string, message string"
#: Records kept; older ones go first.
KEPT = 100_000


@dataclass(frozen=True)
class Pushdown:
    """What skipping did for one scan; the counts are None if the session doesn't count."""

    query_string: str
    filter_type: str  # constant or dynamic
    files_before: int | None
    files_after: int | None
    filters_before: list[str]
    filters_after: list[str]
    path: str


@dataclass
class SessionLog:
    pushdowns: list[Pushdown] = field(default_factory=list)
    records: list[tuple[float, str, str]] = field(default_factory=list)

    def pushdown(self, p: Pushdown) -> None:
        self.pushdowns.append(p)
        self.record("FilterPushdown", json.dumps(asdict(p)))
        del self.pushdowns[:-KEPT]

    def record(self, kind: str, message: str) -> None:
        self.records.append((time.time(), kind, message))
        del self.records[:-KEPT]

    def clear(self) -> None:
        self.pushdowns.clear()
        self.records.clear()

    def pushdown_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(p).values()) for p in self.pushdowns]
        return spark.createDataFrame(rows, PUSHDOWN)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, RECORDS)


def parse_logline(message: str) -> Pushdown:
    """A FilterPushdown record's message as a structure."""
    return Pushdown(**json.loads(message))


class EngineLog(logging.Handler):
    """Keeps log lines of this package as (target, message, file, line) records."""

    def __init__(self, to: SessionLog):
        super().__init__(logging.DEBUG)
        self.to = to

    def emit(self, record: logging.LogRecord) -> None:
        line = {"target": record.name, "message": record.getMessage(), "file": record.filename, "line": record.lineno}
        self.to.record("Engine", json.dumps(line))
