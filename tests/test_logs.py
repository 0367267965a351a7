import json
import logging

from tidemark import logs
from tidemark.sources import settings


def test_json_lines():
    try:
        raise ValueError("é")
    except ValueError:
        import sys

        record = logging.LogRecord("n", logging.INFO, "f", 1, "got %d", (3,), sys.exc_info())
    record.rows = {1, 2}
    found = json.loads(logs.JsonLines().format(record))
    assert (found["level"], found["logger"], found["msg"], found["rows"]) == ("INFO", "n", "got 3", "{1, 2}") and "ValueError: é" in found["error"]
    assert logs.logger("tidemark-test") is logs.logger("tidemark-test") and len(logs.logger("tidemark-test").handlers) == 1


def test_settings():
    assert [len(settings.TERMS[c]) for c in ("nfl", "nba")] == [35, 35]
    assert settings.terms(["nfl", "nfl"])[:2] == ["NFL", "National Football League"] and settings.tags(["nba"]) == {"nba": ["nba", "nba-finals", "nba-playoffs"]}


def test_report(spark, capsys):
    logs.report("by k", spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int"), "k")
    out = capsys.readouterr().out
    assert out.startswith("by k") and out.index("|a") < out.index("|b")
