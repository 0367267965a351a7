"""The corpus kept up to date by batches: what arrives touches the prefixes of its own ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark import schemas
from tidemark.operators import news
from tidemark.sources.snapshots import Snapshots

#: Hex digits of an id that name its part of the state.
DIGITS = 2
_STATE = StructType([*schemas.ARTICLE.fields, StructField("src_rank", IntegerType())])


class CorpusState:
    """One article of each id with the rank of its source, by id prefix, in a table of snapshots.

    After any batches in any order the state is what all of them give at once: of each id the row of least rank, ties as ``news.distinct_articles`` has them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = Snapshots(spark, path)

    def articles(self) -> DataFrame:
        """The corpus as it stands, checked as ``news.unified`` checks it."""
        return schemas.checked(self.table.read(_STATE).drop("src_rank"), "article")

    def update(self, batch: DataFrame) -> dict[str, int]:
        """Take in articles with ``src_rank``; how many prefixes were touched, files read and files left alone. Only touched prefixes are read and written."""
        prefix = F.substring("article_id", 1, DIGITS)
        rows = schemas.conform(batch, _STATE).fillna(0, ["src_rank"]).where("article_id is not null")
        touched = {r[0] for r in rows.select(prefix).distinct().collect()}  # as many as the digits can tell apart at most
        every = self.table.files()
        own = [f for f in every if any(p == f"prefix={x}" for x in touched for p in f.split("/"))]
        both = rows.unionByName(self.table.read(_STATE, only=own))
        best = news.distinct_articles(both, keep_rank=True)
        added = self.table.staged(best.withColumn("prefix", prefix).repartition("prefix"), ("prefix",))
        self.table.commit(added, own)
        return {"touched": len(touched), "read": len(own), "left": len(every) - len(own)}
