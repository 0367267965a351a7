"""Queries over the steps between sources and sinks: joins, quarantines, orders and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import numbers, texts, times
from tidemark.operators import markets, medians, news, pruned, sketches, terms, trades
from tidemark.plans import runs
from tidemark.plans.registry import ORACLES, query, r6, read
from tidemark.sources import corpus_state, lake, snapshots, staging


@query("""
SELECT c_custkey AS market_id, x.t AS token_id, x.r AS token_rank FROM customer, LATERAL (SELECT unnest(['y' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'n' || c_custkey END]) AS t, unnest([0, 1]) AS r) x
WHERE c_acctbal > 0 AND coalesce(x.t, '') <> ''""")
def primary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the primary markets, without empty and missing ones."""
    key = F.col("c_custkey")
    no = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("n"), key.cast("string")))
    own = read(spark, sf_dir, "customer").select(key.alias("market_id"), F.concat(F.lit("y"), key.cast("string")).alias("yes_token_id"), no.alias("no_token_id"), (F.col("c_acctbal") > 0).alias("is_primary_sample"))
    return trades.tokens(own)


@query("""
SELECT c_mktsegment AS category, true AS known, count(*) AS trades FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 GROUP BY 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), false, count(*) FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1""")
def known_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of markets in the universe by category, and those of unknown markets counted for the warning."""
    own = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("market_id"), F.col("c_mktsegment").alias("category"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("end_at"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market_id"))
    here = trades.known(rows, own).groupBy("category").agg(F.count("*").alias("trades")).select("category", F.lit(True).alias("known"), "trades")
    return here.unionByName(trades.unknown(rows, own).select(F.col("market_id").cast("string").alias("category"), F.lit(False).alias("known"), F.col("trade_count").alias("trades")))


@query("""
SELECT o_orderkey, o_custkey AS market_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(epoch(o_orderdate) AS BIGINT), o_orderkey) AS INTEGER) AS place FROM orders""")
def trade_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades with their place in their market's order of time and log index."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("market_id"), times.seconds(F.col("o_orderdate")).alias("ts_s"), F.col("o_orderkey").alias("log_index"), F.lit("").alias("tx_hash"))
    return trades.numbered(trades.in_order(rows)).select("o_orderkey", "market_id", "place")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE l_discount * 9 + 0.05 END AS p, l_linenumber % 5 = 0 AS off, l_returnflag FROM lineitem)
SELECT l_orderkey AS order_key, l_linenumber AS line, nullif(array_to_string([CASE WHEN p >= 1 THEN 'price' END, CASE WHEN p >= 1 OR off THEN 'log_odds' END, CASE WHEN l_returnflag = 'N' THEN 'side' END], ','), '') AS broken FROM t""")
def trade_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as trades: good ones, and those that break rules with the rules' names."""
    price = F.when(F.col("l_linenumber") == 7, F.lit(1.0)).otherwise(F.col("l_discount") * 9 + 0.05)
    odds = F.when(price < 1, F.ln(price / (F.lit(1.0) - F.when(price < 1, price)))) + F.when(F.col("l_linenumber") % 5 == 0, 0.001).otherwise(0.0)
    side = F.when(F.col("l_returnflag") == "A", "YES_BUY").when(F.col("l_returnflag") == "R", "YES_SELL").otherwise("none")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), price.alias("price_raw"), odds.alias("log_odds"), side.alias("side"))
    good, bad = schemas.split_valid(rows, "trade")
    return good.select("order_key", "line", F.lit(None).cast("string").alias("broken")).unionByName(bad.select("order_key", "line", F.array_join("violations", ",").alias("broken")))


@query("""
SELECT o_orderkey, nullif(array_to_string([CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'eligibility' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'precision' END, CASE WHEN o_orderkey % 4 = 3 THEN 'impact' END], ','), '') AS broken FROM orders""")
def event_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as news events: the likelihood takes minute precision only, and values come from their domains."""
    precision = F.when(F.col("o_orderpriority") == "1-URGENT", "minute").when(F.col("o_orderpriority") == "5-LOW", "hour").otherwise("day")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", precision.alias("precision"), (F.col("o_orderstatus") == "F").alias("included_in_hawkes_likelihood"), (F.col("o_orderkey") % 4 - 1).cast("int").alias("directional_impact"))
    return schemas.with_violations(rows, "news_event").select("o_orderkey", F.nullif(F.array_join("violations", ","), F.lit("")).alias("broken"))


@query("""
SELECT c_custkey AS market_id, nullif(array_to_string([CASE WHEN c_custkey % 4 = 3 THEN 'outcome' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'market_type' END, CASE WHEN c_custkey % 5 = 0 THEN 'required' END], ','), '') AS broken,
    ['YES', 'NO', 'INVALID', 'yes'][c_custkey % 4 + 1] AS told FROM customer""")
def market_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as markets with values outside their domains."""
    key = F.col("c_custkey")
    told = F.element_at(F.array(*map(F.lit, ("YES", "NO", "INVALID", "yes"))), (key % 4 + 1).cast("int"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "season_long").when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise(F.col("c_mktsegment"))
    when = F.lit("2024-01-01").cast("timestamp")
    rows = read(spark, sf_dir, "customer").select(key.alias("market_id"), told.alias("resolved_outcome"), kind.alias("market_type"), F.when(key % 5 != 0, when).alias("created_at"), when.alias("end_at"))
    return schemas.with_violations(rows, "market").select("market_id", F.nullif(F.array_join("violations", ","), F.lit("")).alias("broken"), F.col("resolved_outcome").alias("told"))


@query("SELECT c_custkey AS market_id, CASE c_custkey % 6 WHEN 0 THEN 'YES' WHEN 1 THEN 'YES' WHEN 2 THEN 'NO' WHEN 3 THEN 'NO' ELSE 'INVALID' END AS resolved_outcome FROM customer")
def market_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners as the source spells them, to outcomes; other spellings tell nothing."""
    spelled = F.element_at(F.array(*map(F.lit, ("Yes", "YES", "No", "NO", "yes", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("market_id"), markets.outcome(spelled).alias("resolved_outcome"))


@query("""
WITH m AS (SELECT o_orderkey AS id, epoch(o_orderdate) AS s, epoch(o_orderdate) + 86400 * (o_orderkey % 90) AS e FROM orders), b AS (SELECT 852076800.0 AS s, 852076800.0 + 86400 * 365 AS e)
SELECT id, round(CASE WHEN least(m.e - m.s, b.e - b.s) > 0 THEN greatest(0, least(m.e, b.e) - greatest(m.s, b.s)) / least(m.e - m.s, b.e - b.s) ELSE 0 END, 6) + 0.0 AS share FROM m, b""")
def overlap_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of orders' lives, or of a year if that is shorter, that lies in the year; lives without length share nothing."""
    start = times.seconds(F.col("o_orderdate")).cast("double")
    end = start + 86_400 * (F.col("o_orderkey") % 90)
    year = F.lit(852_076_800.0)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), r6(numbers.overlap_fraction(start, end, year, year + 86_400 * 365)).alias("share"))


def _unified_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as articles of feeds and of the knowledge graph, which share some ids."""
    rows = read(spark, sf_dir, "documents").withColumn("article_id", F.sha2((F.col("doc_id") % 600).cast("string"), 256))
    feed = rows.where("doc_id % 5 < 3").select("article_id", F.lit("feed").alias("source"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("published_at"), F.lit("minute").alias("timestamp_precision"))
    graph = rows.where("doc_id % 5 >= 3").select("article_id", F.lit("gkg").alias("source"), F.lit("day").alias("timestamp_precision"))
    return feed, graph


@query("""
WITH d AS (SELECT sha256(CAST(doc_id % 600 AS VARCHAR)) AS article_id, CASE WHEN doc_id % 5 < 3 THEN 0 ELSE 1 END AS r FROM documents)
SELECT article_id, CASE WHEN min(r) = 0 THEN 'feed' ELSE 'gkg' END AS source, CASE WHEN min(r) = 0 THEN 'minute' ELSE 'day' END AS precision FROM d GROUP BY 1""")
def corpus_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of feeds and of the knowledge graph, unified: feeds win, one article of each id, no minute without a time."""
    feed, graph = _unified_sources(spark, sf_dir)
    return news.unified(feed, graph).select("article_id", "source", F.col("timestamp_precision").alias("precision"))


@query("""
WITH o AS (SELECT o_custkey, epoch(o_orderdate)::BIGINT AS s FROM orders WHERE o_custkey % 3 <> 0), m AS (SELECT o_custkey, min(s) AS a, max(s) AS e FROM o GROUP BY 1),
g AS (SELECT *, CAST(floor(a / 86400) AS BIGINT) * 86400 AS f, greatest(1, CAST(ceil((e - floor(a / 86400) * 86400) / 86400) AS BIGINT)) AS bars FROM m)
SELECT CAST(g.o_custkey AS VARCHAR) AS market_id, any_value(bars) AS bars, count(*) FILTER (WHERE o.s < f + 86400 * bars) AS trades FROM g JOIN o USING (o_custkey) GROUP BY g.o_custkey""")
def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of markets' whole lives; markets without trades have none, trades of every third customer, who is no market, count for nothing."""
    orders = read(spark, sf_dir, "orders")
    own = orders.where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").cast("string").alias("market_id")).agg(F.min("o_orderdate").cast("timestamp").alias("created_at"), F.max("o_orderdate").cast("timestamp").alias("end_at"))
    idle = spark.range(3).select(F.concat(F.lit("idle"), F.col("id").cast("string")).alias("market_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-09").cast("timestamp").alias("end_at"))
    rows = orders.select(F.col("o_custkey").cast("string").alias("market_id"), times.seconds(F.col("o_orderdate")).alias("ts_s"), F.col("o_orderkey").alias("log_index"), F.lit("").alias("tx_hash"), F.lit(0.5).alias("log_odds"), F.col("o_totalprice").alias("size_usdc"))
    found = runs.market_bars(rows, own.unionByName(idle), 86_400)
    return found.groupBy("market_id").agg(F.count("*").alias("bars"), F.sum("trade_count").alias("trades"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate AS d, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d %H:%M:%S') AS iso, CASE WHEN o_orderkey % 2 = 0 THEN strftime(d, '%Y-%m-%d') || ' 08:15:00' END AS rss, strftime(d, '%Y-%m-%d') || ' 23:59:00' AS game_end,
    y || '-' || substr(CAST(y + 1 AS VARCHAR), 3, 2) AS season, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE CAST(y AS VARCHAR) END AS number_year, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(d, '%m') END AS number_month,
    '["' || o_orderkey || '","x"]' AS listed, CAST(2 AS INTEGER) AS list_size FROM t""")
def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the sources' formats, bad ones among them, and lists in JSON."""
    day = F.col("o_orderdate").cast("timestamp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    mail = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:15:00 +0200"))).otherwise(F.lit("soon"))
    number = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.date_format(day, "yyyyMMddHHmmss").cast("long"))
    year, month = times.number_year_month(number)
    listed = F.concat(F.lit('["'), F.col("o_orderkey").cast("string"), F.lit('","x"]'))
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", text(times.iso(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"), text(times.rss(mail)).alias("rss"), text(times.game_end(F.date_format(day, "yyyy-MM-dd"))).alias("game_end"), texts.season(day).alias("season"), year.alias("number_year"), month.alias("number_month"), F.to_json(texts.from_json_list(listed)).alias("listed"), F.size(texts.from_json_list(listed)).alias("list_size"))


@query(ORACLES["ip_topk"])
def ip_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ip_topk`` through an index of blocks whose bounds tell which ones need no look."""
    every = read(spark, sf_dir, "embeddings")
    index = pruned.build(every.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    found, _ = pruned.search(every.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), index, 10)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("""
WITH o AS (SELECT l_returnflag AS f, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem)
SELECT f AS flag, round(median(v), 6) AS middle FROM o GROUP BY 1""")
def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of lineitems' prices by flag, and in one group that holds all."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    found = medians.exact_median(line.unionByName(line.withColumn("flag", F.lit("all"))), ["flag"], "v", "middle")
    return found.select("flag", r6("middle").alias("middle"))


@query("""
SELECT v.version, count(*) AS rows, sum(e.vec_id) AS ids, sum(len(e.embedding)) AS numbers FROM embeddings e, (VALUES (1), (2), (3)) v(version)
WHERE v.version = 3 OR e.label % 3 < v.version GROUP BY 1""")
def embedding_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings appended by three runs, of which one died and was run again: what readers of each version see. The second and third read the table that they append to."""
    every = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    table = snapshots.Snapshots(spark, staging.folder(spark, "embeddings"))
    for label in range(3):
        new = every.where(F.col("label") % 3 == label if label < 2 else F.lit(True)).join(table.read(every.schema).select("vec_id"), "vec_id", "left_anti").select(every.columns)
        if label == 1:
            table.staged(new)  # a run that died before its commit: its files belong to no version
        table.append(new)
    versions = [table.read(every.schema, v).withColumn("version", F.lit(v)) for v in table.versions()]
    whole = versions[0].unionByName(versions[1]).unionByName(versions[2])
    return whole.groupBy("version").agg(F.count("*").alias("rows"), F.sum("vec_id").alias("ids"), F.sum(F.size("embedding")).alias("numbers"))


@query(ORACLES["corpus_unified"])
def corpus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of ``corpus_unified`` out of three batches of documents, each of which touches the prefixes of its own ids only."""
    feed, graph = _unified_sources(spark, sf_dir)
    both = news.ranked_union(schemas.conform(feed, schemas.ARTICLE), schemas.conform(graph, schemas.ARTICLE))
    batch = F.pmod(F.xxhash64("article_id", "src_rank"), F.lit(3))
    state = corpus_state.CorpusState(spark, staging.folder(spark, "corpus"))
    for n in range(3):
        state.update(both.where(batch == n))
    return state.articles().select("article_id", "source", F.col("timestamp_precision").alias("precision"))


@query(ORACLES["known_trades"])
def known_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``known_trades`` over tables that lie by market: the joins move no row."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = lambda what: f"{what}_{uuid.uuid4().hex}"
    own = read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("market_id"), F.col("c_mktsegment").alias("category"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("end_at"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market_id"))
    own, rows = (lake.write_colocated(df, name(what), staging.folder(spark, what), "market_id", parts) for df, what in ((own, "markets"), (rows, "trades")))
    here = trades.known(rows.hint("merge"), own).groupBy("category").agg(F.count("*").alias("trades")).select("category", F.lit(True).alias("known"), "trades")
    return here.unionByName(trades.unknown(rows.hint("merge"), own).select(F.col("market_id").cast("string").alias("category"), F.lit(False).alias("known"), F.col("trade_count").alias("trades")))


@query("""
SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS rows, count(DISTINCT o_custkey) AS customers, true AS distinct_within, true AS median_within FROM orders GROUP BY 1""")
def sketched_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and median prices of each year out of the months' sketches, held against the rows: whether each estimate is within its stated error."""
    rows = read(spark, sf_dir, "orders").withColumns({"year": F.date_format("o_orderdate", "yyyy"), "month": F.date_format("o_orderdate", "MM")})
    kept = staging.written(sketches.sketched(rows, ["year", "month"], {"customers": "o_custkey"}, {"price": "o_totalprice"}), "sketches")
    told = sketches.estimates(sketches.merged(kept, ["year"], ["customers"], ["price"]), ["customers"], {"price": [0.5]})
    told = told.select(F.col("year").alias("_year"), F.col("customers").alias("_customers"), F.col("price")[0].alias("_price"))
    exact = rows.join(F.broadcast(told), F.col("year") == F.col("_year")).groupBy("year").agg(  # a row for each year
        F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.first("_customers").alias("_customers"), F.avg((F.col("o_totalprice") <= F.col("_price")).cast("double")).alias("_rank")
    )
    near = F.abs(F.col("_customers") - F.col("customers")) <= sketches.distinct_error() * F.col("customers")
    return exact.select("year", "rows", "customers", near.alias("distinct_within"), (F.abs(F.col("_rank") - 0.5) <= sketches.QUANTILE_ERROR + 1 / F.col("rows")).alias("median_within"))


@query("""
WITH t AS (SELECT DISTINCT substr(c_name, 10) AS term FROM customer WHERE c_acctbal < 5000), g AS (SELECT o_orderkey, 'x' || c_name || ';' || o_orderpriority AS named FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, count(*) AS terms, min(term) AS first FROM g JOIN t ON contains(named, term) GROUP BY 1""")
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as knowledge-graph rows whose persons hold one of very many terms, parts of customers' names; a list of terms is for the driver."""
    own = read(spark, sf_dir, "customer")
    listed = [r[0] for r in own.where("c_acctbal < 5000").select(F.substring("c_name", 10, 99)).distinct().collect()]
    rows = read(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat(F.lit("x"), "c_name").alias("V2Persons"), F.col("o_orderpriority").alias("V2Organizations"))
    found = terms.holding(rows, F.concat_ws(";", "V2Persons", "V2Organizations"), listed, "found")
    return found.select("o_orderkey", F.size("found").cast("long").alias("terms"), F.col("found")[0].alias("first"))
