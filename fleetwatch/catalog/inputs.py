"""The driver's tables read as fleet telemetry, in Spark and as SQL.

``events`` are commands, odometry and messages of one robot per user;
``embeddings`` are scans; ``orders`` are episodes; ``lineitem`` are steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.timeline import ntz_micros

KEY = b"fleet-secret"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(robot_id, recv_ts, seq, us, kind, k, value, v_lin, v_ang, props, event_type, user_id)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("robot_id"),
        F.timestamp_micros(ntz_micros("ts")).alias("recv_ts"),
        F.col("event_id").alias("seq"),
        ntz_micros("ts").alias("us"),
        k.alias("k"),
        "value",
        ((F.col("value") - 50) / 200).alias("v_lin"),
        ((k - 50) / 10).alias("v_ang"),
        "props",
        "event_type",
        "user_id",
    )


# One row per event for the SQL side, same columns.
EV = """ev AS (
  SELECT 'r' || user_id AS robot_id, event_id AS seq, epoch_us(ts) AS us, k, value,
         (value - 50) / 200 AS v_lin, (k - 50) / 10.0::DOUBLE AS v_ang, props, event_type, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as scans: robot = label, 1.75 + 5 e metres, one frame per vec_id second."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("r"), F.col("label").cast("string")).alias("robot_id"),
        F.timestamp_seconds("vec_id").alias("recv_ts"),
        F.col("vec_id").alias("seq"),
        F.transform("embedding", lambda x: 1.75 + 5.0 * x.cast("double")).alias("ranges"),
    )


SC = """sc AS (
  SELECT 'r' || label AS robot_id, vec_id AS seq, vec_id * 1000000 AS us,
         list_transform(embedding, lambda x: 1.75 + 5.0 * x::DOUBLE) AS ranges
  FROM embeddings)"""


def repeated_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans with repeats: each frame is the one of the six-block's start, robots of 60 frames."""
    emb = table(spark, sf, "embeddings")
    base = emb.select(F.col("vec_id").alias("_b"), F.transform("embedding", lambda x: 1.75 + 5.0 * x.cast("double")).alias("ranges"))
    return (
        emb.select("vec_id", (F.col("vec_id") - F.col("vec_id") % 6).alias("_b"))
        .join(base, "_b")
        .select(
            F.concat(F.lit("r"), F.floor(F.col("vec_id") / 60).cast("string")).alias("robot_id"),
            F.timestamp_seconds("vec_id").alias("recv_ts"),
            F.col("vec_id").alias("seq"),
            "ranges",
        )
    )


RS = """rs AS (
  SELECT 'r' || (a.vec_id // 60) AS robot_id, a.vec_id AS seq, a.vec_id * 1000000 AS us,
         list_transform(b.embedding, lambda x: 1.75 + 5.0 * x::DOUBLE) AS ranges
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 6)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as episodes: run = priority, order (date, key)."""
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderpriority").alias("run_id"),
        ntz_micros("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("episode"),
        F.col("o_totalprice").alias("reward"),
        (F.col("o_custkey") % 500).cast("int").alias("steps"),
        (F.col("o_totalprice") / 500000).alias("spl"),
        (status == "F").cast("int").alias("success"),
        (status == "O").cast("int").alias("collision"),
        (status == "P").cast("int").alias("timeout"),
        (F.col("o_custkey") % 4).cast("int").alias("wp_done"),
        F.when(status == "P", F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 100000).alias("clearance"),
        F.when(status == "F", "all_done").when(status == "O", "collision").otherwise("timeout").alias("event"),
    )


EP = """ep AS (
  SELECT o_orderpriority AS run_id, epoch_us(o_orderdate) AS day, o_orderkey AS episode, o_totalprice AS reward,
         CAST(o_custkey % 500 AS INT) AS steps, o_totalprice / 500000 AS spl,
         (o_orderstatus = 'F')::INT AS success, (o_orderstatus = 'O')::INT AS collision, (o_orderstatus = 'P')::INT AS timeout,
         CAST(o_custkey % 4 AS INT) AS wp_done,
         CASE WHEN o_orderstatus = 'P' THEN 'inf'::DOUBLE ELSE o_totalprice / 100000 END AS clearance,
         CASE o_orderstatus WHEN 'F' THEN 'all_done' WHEN 'O' THEN 'collision' ELSE 'timeout' END AS event
  FROM orders)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as steps of the episode l_orderkey, numbered by a total order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"
    )
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.lit("run").alias("run_id"),
        F.col("l_orderkey").alias("episode"),
        F.row_number().over(w).alias("step"),
        (F.col("l_quantity") / 10 - 2.5).alias("x"),
        (F.col("l_extendedprice") / 20000 - 2.5).alias("y"),
        (F.col("l_tax") * 50).alias("yaw"),
        F.col("l_discount").alias("reward"),
        F.when(flag == "R", "collision").when(flag == "A", "all_done").otherwise("running").alias("event"),
        F.array((F.col("l_quantity") - 25) / 25, (F.col("l_discount") - 0.05) * 20).alias("action"),
        (F.col("l_quantity") / 50 + 0.1).alias("nearest"),
        (F.col("l_partkey") % 5).cast("int").alias("raw_action"),
        ((F.col("l_suppkey") % 5) - 2.0).alias("gx"),
        ((F.col("l_partkey") % 5) - 2.0).alias("gy"),
    )


ST = """st AS (
  SELECT 'run' AS run_id, l_orderkey AS episode,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax)::INT AS step,
         l_quantity / 10 - 2.5 AS x, l_extendedprice / 20000 - 2.5 AS y, l_tax * 50 AS yaw, l_discount AS reward,
         CASE l_returnflag WHEN 'R' THEN 'collision' WHEN 'A' THEN 'all_done' ELSE 'running' END AS event,
         (l_quantity - 25) / 25 AS a0, (l_discount - 0.05) * 20 AS a1, l_quantity / 50 + 0.1 AS nearest,
         CAST(l_partkey % 5 AS INT) AS raw_action, (l_suppkey % 5) - 2.0::DOUBLE AS gx, (l_partkey % 5) - 2.0::DOUBLE AS gy
  FROM lineitem)"""


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as waypoints: route = region, order by key."""
    from pyspark.sql import Window as W

    w = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("route_id"),
        (F.row_number().over(w) - 1).alias("seq"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 5 - 2).cast("double").alias("x"),
        (F.floor(F.col("n_nationkey") / 5) - 2).cast("double").alias("y"),
    )


WP = """wp AS (
  SELECT n_regionkey::VARCHAR AS route_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT - 1 AS seq,
         n_name AS name, (n_nationkey % 5 - 2)::DOUBLE AS x, (n_nationkey // 5 - 2)::DOUBLE AS y
  FROM nation)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 2000 - 2.5).alias("x"),
        ((F.col("c_custkey") * 37 % 1000) / 200 - 2.5).alias("y"),
    )


PT = """pt AS (SELECT c_custkey, c_acctbal / 2000 - 2.5 AS x, (c_custkey * 37 % 1000) / 200.0::DOUBLE - 2.5 AS y FROM customer)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly node graphs: robot = event type, node = user, poll = hour."""
    hour = F.floor(F.col("us") / 3_600_000_000)
    return (
        events(spark, sf)
        .select(
            F.col("event_type").alias("robot_id"),
            hour.alias("poll_seq"),
            F.timestamp_seconds(hour * 3600).alias("poll_ts"),
            F.concat(F.lit("/ns/u"), F.col("user_id").cast("string")).alias("node"),
        )
        .distinct()
    )


SN = """sn AS (
  SELECT DISTINCT event_type AS robot_id, us // 3600000000 AS poll_seq, '/ns/u' || user_id AS node FROM ev)"""


def whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("name"))


WL = "wl AS (SELECT 'u' || s_suppkey AS name FROM supplier)"


def publishers(spark: SparkSession, sf: str) -> DataFrame:
    """Publisher snapshots: robot = value decile, tick = day, topic = event type, node = user mod 40."""
    return events(spark, sf).select(
        F.concat(F.lit("d"), F.floor(F.col("value") / 10).cast("string")).alias("robot_id"),
        F.timestamp_seconds(F.floor(F.col("us") / 86_400_000_000) * 86400).alias("tick_ts"),
        F.concat(F.lit("/"), F.col("event_type")).alias("topic"),
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("node_name"),
    )


PB = """pb AS (
  SELECT 'd' || floor(value / 10)::BIGINT AS robot_id, us // 86400000000 * 86400 AS tick_s, '/' || event_type AS topic,
         'u' || (user_id % 40) AS node_name FROM ev)"""

EVENT_TOPICS = ("/click", "/error", "/purchase", "/signup", "/view")


def topic_allow(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as an allow-list: node u0..u39 may publish every topic but the one of its number."""
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"))
    topics = F.array(*[F.lit(t) for t in EVENT_TOPICS])
    return own.select(F.concat(F.lit("u"), F.col("n").cast("string")).alias("node_name"), F.posexplode(topics).alias("p", "topic"), "n").where(
        "n % 5 != p"
    ).select("topic", "node_name")


AL = """al AS (
  SELECT t.topic, 'u' || s_suppkey AS node_name FROM supplier,
         (VALUES (0, '/click'), (1, '/error'), (2, '/purchase'), (3, '/signup'), (4, '/view')) t(p, topic)
  WHERE s_suppkey % 5 <> t.p)"""


def text_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def ticks(spark: SparkSession, sf: str, hours: int = 6) -> DataFrame:
    """A tick grid per robot over its own time span."""
    from ..plans.asof import make_ticks

    return make_ticks(events(spark, sf), "robot_id", "recv_ts", hours * 3600)


def tk(hours: int = 6) -> str:
    step = hours * 3_600_000_000
    return f"""tk AS (
  SELECT robot_id, unnest(range(min(us) // {step} * {step}, (max(us) + {step} - 1) // {step} * {step} + 1, {step})) AS t
  FROM ev GROUP BY robot_id)"""


def seconds(c: str) -> Column:
    return (F.unix_micros(c) / 1e6)
