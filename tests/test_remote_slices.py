"""Slices of remote services that stay small however much a service holds."""

import json

from pyarrow import parquet
from pyspark.sql import functions as F

from tidemark.operators import news
from tidemark.sources import http, remote


def test_a_games_log_is_asked_for_day_by_day():
    asked = []

    def client(method, url, data):
        asked.append((data.get("DateFrom"), data.get("DateTo")))
        return {"resultSets": [{"headers": ["H"], "rowSet": [[data.get("DateFrom"), None]]}]}

    found = list(remote.game_log(client, "2024-25", "Playoffs", "2024-02-28", "2024-03-03", 2))
    assert asked == [("02/28/2024", "02/29/2024"), ("03/01/2024", "03/02/2024"), ("03/03/2024", "03/03/2024")]
    assert [p["rowSet"] for p in found] == [[[day, None]] for day, _ in asked]
    slices = remote._SLICES["remote_games"]({"seasons": "2024-25", "days": "1"})
    assert len(slices) == 48 and (slices[0]["start"], slices[23]["end"]) == ("2024-01-01", "2025-12-31")
    assert all(a["end"] < b["start"] for a, b in zip(slices[:24], slices[1:24]))
    assert remote._SLICES["remote_games"]({"seasons": "2024-25"}) == [{"season": "2024-25", "season_type": t} for t in remote.SEASON_TYPES]


def _service(items, size=4):
    pages = [items[at : at + size] for at in range(0, len(items), size)]

    def client(method, url, data):
        if data["page"] > len(pages):
            raise http.HttpError(404)
        return {"pageCount": len(pages), "articles": pages[data["page"] - 1]}

    return client


def test_lanes_of_a_sport_end_where_one_reader_ends(spark):
    for days in ([9] * 9 + [None, 3, None, 9, 3], [9] * 30, [3], [9, None, 9], [9] * 17 + [3] * 20):
        items = [{"n": n} | ({"published": f"2024-08-0{d}"} if d else {}) for n, d in enumerate(days)]
        client = _service(items)
        want = [i["n"] for _, _, i in remote.news_pages(client, "s", "2024-08-05")]
        for lanes in (2, 5, 64):
            told = [(p, n, "s", json.dumps(i) if i else None) for lane in range(lanes) for p, n, i in remote.news_pages(client, "s", "2024-08-05", lane, lanes)]
            if told:
                got = news.before_the_end(spark.createDataFrame(told, "page int, pos int, sport string, item string")).orderBy("page", "pos")
                assert [json.loads(r["item"])["n"] for r in got.collect()] == want


def test_a_sports_pages_are_read_by_several_tasks():
    assert len(remote._SLICES["remote_news"]({"sports": "a,b", "start": "2024-08-05", "lanes": "8"})) == 16


def test_a_request_reads_few_of_its_parts_answers(spark, tmp_path):
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.sha2((x * F.col("id")).cast("string"), 256)), "")
    http.record(spark.range(4000).select(F.format_string('["GET","u",{"i":%d}]', F.col("id")).alias("key"), body.alias("body")), f"{tmp_path}/r")
    groups = [parquet.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "r").glob("part=*/*.parquet")]
    assert sum(groups) > 400  # 770 MB of bodies, 64 parts
    ask = http.Recorded(f"{tmp_path}/r")
    assert all(len(ask("GET", "u", {"i": i})) == 3000 * 64 for i in range(0, 4000, 370))
    largest = max(parquet.ParquetFile(f).metadata.row_group(g).num_rows for f in (tmp_path / "r").glob("part=*/*.parquet") for g in range(parquet.ParquetFile(f).metadata.num_row_groups))
    assert largest <= 20
