"""Log lines as JSON, and printed reports; both are the driver's."""

from __future__ import annotations

import json
import logging
import sys

from pyspark.sql import DataFrame

_PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """A record as one JSON object, with what was passed as ``extra``; values that JSON can't hold are text."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "msg": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def logger(name: str) -> logging.Logger:
    """The logger of a name; it writes JSON lines to standard error, once however often it is asked for."""
    found = logging.getLogger(name)
    if not any(isinstance(h.formatter, JsonLines) for h in found.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(JsonLines())
        found.addHandler(handler)
        found.setLevel(logging.INFO)
        found.propagate = False
    return found


def report(title: str, df: DataFrame, *order: str) -> None:
    """Print a report: a grouped aggregate of a few rows, in order."""
    print(title)
    (df.orderBy(*order) if order else df).show(100, truncate=False)
