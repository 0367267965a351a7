"""Parquet tables in hive layout, and SQL views over them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import news, vectors
from tidemark.sources import staging

#: Views, and the key that their path has in whatever section of the configuration.
VIEWS = {"universe": "universe", "trades": "trades", "bars_1min": "bars_1min", "gdelt_gkg": "gdelt_gkg", "feed_articles": "feeds"}
#: Columns of directories, by table; always text, so that months keep their zero and "unknown" may stand beside them.
LAYOUT = {"trades": ("category", "year", "month"), "bars_1min": ("category", "year", "month"), "gdelt_gkg": ("year", "month"), "feed_articles": ("source", "year", "month"), "corpus": ("year", "month")}


def has_files(spark: SparkSession, path: str, ending: str = ".parquet") -> bool:
    """Whether a path is such a file or has one at any depth; on any file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return False
    found = system.listFiles(where, True)
    while found.hasNext():
        if found.next().getPath().getName().endswith(ending):
            return True
    return False


def _place(spark: SparkSession, path: str) -> str | None:
    """A path as pyarrow takes it; none if it doesn't know the scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(where)
    place = full.toUri().getPath() if system.getUri().getScheme() == "file" else full.toString()
    try:
        _opened(place)
    except (pa.ArrowException, OSError):
        return None
    return place


#: Directories of one level beyond which Spark's own listing, quadratic in them, isn't used.
MANY = 4_000


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _many_directories(place: str) -> list[str]:
    """The partitions' directories of the first level that has very many; empty if none has, or if files lie beside or above them."""
    from pyarrow import fs

    where, root = _opened(place)
    level = [root] if where.get_file_info(root).type == fs.FileType.Directory else []
    while level:
        found = [x for folder in level for x in where.get_file_info(fs.FileSelector(folder)) if not _hidden(x.base_name)]
        level = [x.path for x in found if x.type == fs.FileType.Directory and "=" in x.base_name]
        if len(level) < len(found):
            return []
        if len(level) > MANY:
            return level
    return []


def _files(where, folder: str) -> list[str]:
    """The files below a directory that readers see."""
    from pyarrow import fs

    found = (x.path for x in where.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File)
    return [f for f in found if not any(map(_hidden, f[len(folder) + 1 :].split("/")))]


def _from_directories(spark: SparkSession, place: str, folders: list[str], whole: StructType, partitions: tuple[str, ...]) -> DataFrame:
    """The table below these directories, listed and read by tasks; partitions stand last in ``whole``, as text.

    Spark's own way lists on the driver what tasks found, tells the values of each directory in quadratic time, and opens a file in milliseconds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(whole)
    data = [f for f in want if f.name not in partitions]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _opened(place)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                yield pa.RecordBatch.from_pydict({"path": pa.array(_files(where, folder), pa.string())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        where, root = _opened(place)
        held, count, size = [], 0, 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                told = dict(x.split("=", 1) for x in path[len(root) :].split("/")[:-1] if "=" in x)
                values = [None if told.get(p, _NONE) == _NONE else unquote(told[p]) for p in partitions]
                with where.open_input_file(path) as file:
                    for part in parquet.ParquetFile(file).iter_batches(_ROWS, use_threads=False):
                        n, have = part.num_rows, set(part.schema.names)
                        own = [part[f.name].cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in data]
                        held.append(pa.RecordBatch.from_arrays(own + [pa.array([v] * n, pa.string()) for v in values], schema=want))
                        count, size = count + n, size + held[-1].nbytes
                        if count >= _ROWS or size > _GROUP:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, count, size = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    tasks = max(4 * spark.sparkContext.defaultParallelism, len(folders) // 100)
    given = spark.createDataFrame([(f,) for f in folders], "path string").repartition(tasks)
    return given.mapInArrow(listed, "path string").repartition(tasks).mapInArrow(rows, whole)


def _whole(schema: StructType, partitions: tuple[str, ...]) -> StructType:
    """A table's columns, those of its directories last and as text."""
    return StructType.fromDDL(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in partitions] + [f"`{p}` string" for p in partitions]))


def table(spark: SparkSession, path: str, schema: StructType, partitions: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at a path, with a declared schema; without files an empty one. Filters on partition columns prune directories, unless there are very many."""
    whole = _whole(schema, partitions)
    if not has_files(spark, path):
        return spark.createDataFrame([], whole)
    place = _place(spark, path) if partitions else None
    if place and (folders := _many_directories(place)):
        return _from_directories(spark, place, folders, whole, partitions)
    return spark.read.schema(whole).parquet(path)


def _viewed(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at a path, with the schema of a file; partition columns of very many directories are text."""
    place = _place(spark, path)
    folders = _many_directories(place) if place else []
    where, root = _opened(place) if folders else (None, "")
    first = next((f for folder in folders for f in _files(where, folder)), None)
    if first is None:
        return spark.read.parquet(path)
    names = tuple(x.split("=", 1)[0] for x in first[len(root) :].split("/")[:-1] if "=" in x)
    return _from_directories(spark, place, folders, _whole(spark.read.parquet(path.rstrip("/") + first[len(root) :]).schema, names), names)


def register_views(spark: SparkSession, paths: Mapping[str, Mapping[str, str]]) -> list[str]:
    """Register a view for every configured path that has files; gives their names."""
    flat = {key: path for section in paths.values() if isinstance(section, Mapping) for key, path in section.items()}
    made = [view for view, key in VIEWS.items() if flat.get(key) and has_files(spark, flat[key])]
    for view in made:
        _viewed(spark, flat[VIEWS[view]]).createOrReplaceTempView(view)
    return made


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Any SQL over the registered views."""
    return spark.sql(text)


#: Bytes of a row group; bytes and rows under which a directory is small; rows that small files are put together to.
_GROUP, _SMALL, _FEW, _ROWS = 32 << 20, 1 << 20, 256, 4096
#: Characters that a directory's name can't hold, and the name that stands for no value.
_ODD, _NONE = re.compile("[\\x00-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _directory(names: tuple[str, ...], values: tuple[str | None, ...]) -> str:
    """A partition's path, as Spark reads it."""
    return "/".join(f"{n}={_ODD.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else _NONE}" for n, v in zip(names, values))


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """``(values, rows)`` of stretches that share their partition's values."""
    for batch in batches:
        columns = [batch[n].to_pylist() for n in names]
        keys, rows = list(zip(*columns)), pa.Table.from_batches([batch])
        at = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[at]:
                yield keys[at], rows.slice(at, end - at)
                at = end


def _opened(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _write_directories(df: DataFrame, path: str, partitions: tuple[str, ...]) -> int:
    """Write rows that are dealt by their partitions, a file for each partition in a task; gives the number of files.

    Tasks hold so many bytes, which says little of the work: a megabyte may go to one directory or to 20,000. So what is large is written where it is, and
    small directories are dealt once more, to many tasks by their number.

    Files are opened by pyarrow, which must know the folder's scheme: Hadoop's local file system starts a process for each directory and each file
    to set its mode. A task's files have fixed names and come by a rename, so a task that runs again writes the same ones.
    """

    def writing(kind: str, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Writes directories of ``least`` bytes or more, or of more than few rows. Gives the rows of others, or without a least the number of files."""

        def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import parquet

            where, root = _opened(path)
            context = TaskContext.get()
            name, attempt = f"part-{kind}-{context.partitionId():05d}.snappy.parquet", context.taskAttemptId()
            values, held, size, writer, folder, made, passed, passing = None, [], 0, None, "", 0, [], 0

            def flush() -> None:
                nonlocal writer, held, size, folder
                rows = pa.concat_tables(held).drop_columns(list(partitions)).combine_chunks()
                if writer is None:
                    folder = f"{root}/{_directory(partitions, values)}"
                    where.create_dir(folder, recursive=True)
                    writer = parquet.ParquetWriter(f"{folder}/_{attempt}", rows.schema, filesystem=where)
                writer.write_table(rows)
                held, size = [], 0

            def close() -> None:
                nonlocal writer, made, held, size, passing
                if writer is None and size < least and sum(t.num_rows for t in held) < _FEW:
                    passed.extend(held)
                    passing += size
                    held, size = [], 0
                    return
                if held:
                    flush()
                writer.close()
                where.move(f"{folder}/_{attempt}", f"{folder}/{name}")
                writer, made = None, made + 1

            def others() -> Iterator[pa.RecordBatch]:
                nonlocal passing
                rows = pa.concat_tables(passed).combine_chunks()
                passed.clear()
                passing = 0
                yield from rows.to_batches()

            for own, rows in _runs(batches, partitions):
                if own != values:
                    if values is not None:
                        close()
                    if len(passed) >= _ROWS or passing > _GROUP:
                        yield from others()
                    values = own
                held.append(rows)
                size += rows.nbytes
                if size > _GROUP:
                    flush()
            if values is not None:
                close()
            if passed:
                yield from others()
            if not least:
                yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

        return files

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    small = df.sortWithinPartitions(*partitions).mapInArrow(writing("a", _SMALL), _whole(df.schema, ()))
    dealt = small.repartition(tasks, *partitions).sortWithinPartitions(*partitions)
    return dealt.mapInArrow(writing("b", 0), "files long").agg(F.sum("files")).first()[0] or 0


def write(df: DataFrame, path: str, partitions: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write a table; rows of a partition meet in few tasks first, with a hot one spread by ``REBALANCE`` instead of gathered.

    A partitioned table that replaces what is there is written aside and comes by one rename, with ``_SUCCESS`` in it; where pyarrow doesn't know the folder's scheme,
    and in other modes, Spark writes it. Its committer leaves ``_SUCCESS`` once everything is there, and nothing that counts before.
    """
    spark, hadoop = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs
    df = df.hint("rebalance", *partitions)
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = system.makeQualified(hadoop.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}"))
    place = _place(spark, aside.toString())
    if not (place and partitions and mode == "overwrite"):
        writer = df.write.mode(mode)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        return
    system.mkdirs(aside)
    _write_directories(df.withColumns({c: F.col(c).cast("string") for c in partitions}), place, partitions)
    system.create(hadoop.Path(aside, "_SUCCESS")).close()
    staging.delete(spark, path)
    if not system.rename(aside, hadoop.Path(path)):
        raise OSError(f"{aside.toString()} couldn't be moved to {path}")


def _by_end(df: DataFrame, markets: DataFrame) -> DataFrame:
    year, month = times.year_month(F.col("end_at"))
    own = markets.select("market_id", "category", year.alias("year"), month.alias("month"))
    return df.drop("category", "year", "month").join(own, "market_id")


def write_universe(markets: DataFrame, path: str) -> None:
    """The universe, tags as JSON text; a typed empty table if there are no markets."""
    write(schemas.conform(markets, schemas.MARKET).withColumn("tags", F.to_json("tags")), path)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The universe as it was before it was written."""
    flat = StructType.fromDDL(", ".join(f"{f.name} {'string' if f.name == 'tags' else f.dataType.simpleString()}" for f in schemas.MARKET))
    return table(spark, path, flat).withColumn("tags", F.from_json("tags", "array<string>"))


def write_trades(trades: DataFrame, markets: DataFrame, path: str) -> None:
    """Trades by category and by year and month of their market's end."""
    write(_by_end(schemas.conform(trades, schemas.TRADE), markets), path, LAYOUT["trades"])


def write_bars(bars: DataFrame, markets: DataFrame, path: str) -> None:
    """Bars, laid out as their trades."""
    write(_by_end(schemas.conform(bars, schemas.BAR), markets), path, LAYOUT["bars_1min"])


def write_gkg(gkg: DataFrame, path: str) -> None:
    """Knowledge-graph rows by year and month of their date number; rows without one under ``unknown``."""
    year, month = times.number_year_month(F.col("DATE"))
    write(gkg.withColumns({"year": year, "month": month}), path, LAYOUT["gdelt_gkg"])


def write_feeds(articles: DataFrame, path: str) -> None:
    """Feed articles by source, year and month; undated ones under ``unknown``."""
    year, month = times.year_month(F.col("published_at"))
    write(schemas.conform(articles, schemas.ARTICLE).withColumns({"year": year, "month": month}), path, LAYOUT["feed_articles"])


def write_corpus(articles: DataFrame, path: str) -> None:
    """The unified corpus by year and month."""
    write(news.corpus_partition(schemas.conform(articles, schemas.ARTICLE)), path, LAYOUT["corpus"])


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Embeddings as half-precision bytes, in one table for all."""
    write(vectors.pack_half(rows), path)


def read_embeddings(spark: SparkSession, path: str, id_col: str = "article_id") -> DataFrame:
    """``(id, embedding)`` from such a table; without files an empty one."""
    return vectors.unpack_half(table(spark, path, StructType.fromDDL(f"{id_col} string, embedding binary")))


def write_id_map(rows: DataFrame, path: str, id_col: str = "article_id") -> None:
    """The side table ``(faiss_row, id)`` of an index over these embeddings."""
    write(vectors.numbered(rows, id_col), path)


def read_corpus(spark: SparkSession, unified: str, feeds: str, gkg: str) -> DataFrame:
    """The unified corpus if it was written, else feeds and knowledge-graph articles unified anew."""
    if has_files(spark, unified):
        return table(spark, unified, schemas.ARTICLE, LAYOUT["corpus"]).select(*schemas.ARTICLE.names)
    return news.unified(table(spark, feeds, schemas.ARTICLE, LAYOUT["feed_articles"]), news.gkg_articles(table(spark, gkg, schemas.GKG, LAYOUT["gdelt_gkg"])))


def config(text: str, parse: Callable[[str], object] | None = None) -> dict:
    """Configuration from text: JSON, or YAML where that library is installed; ``parse`` may be given instead."""
    if parse is None:
        try:
            return json.loads(text)
        except ValueError:
            import yaml

            parse = yaml.safe_load
    return dict(parse(text) or {})


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table out of configuration."""
    return spark.createDataFrame(rows, schema)


def partition_filter(**values: str) -> Column:
    """Equality on partition columns, which prunes directories."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == F.lit(value))
    return out


def write_colocated(df: DataFrame, name: str, path: str, key: str, parts: int) -> DataFrame:
    """Write a table dealt by a key to ``parts`` buckets and sorted within them, registered as ``name``; the table, read again.

    Tables of one key and number of buckets are joined and grouped by that key without moving a row, at every later run that reads them.
    """
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
