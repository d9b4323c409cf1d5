"""Node-graph and publisher snapshots: differences, allow-lists, node alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import full_name, short_name
from ..plans.replay import thin
from ..plans.timeline import Timeline

# A publisher with an undiscovered name is ignored; these two
# nodes may publish stop commands beside the driver of the robot.
UNKNOWN_PUBLISHER = "_NODE_NAME_UNKNOWN_"
SECURITY_NODES = ("dds_security_monitor", "intelligent_defense_node")
WATCHED_TOPICS = ("/cmd_vel", "/scan", "/odom", "/imu")
GRACE_S, ALERT_TTL_S = 15.0, 600.0

# Allow-lists reach the executors as joins; Spark broadcasts them while they
# stay under spark.sql.autoBroadcastJoinThreshold and shuffles them beyond.


def with_node(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("node", full_name(F.col("namespace"), F.col("name")))


def polls(snapshots: DataFrame) -> DataFrame:
    """(robot_id, poll_seq, poll_ts, prev_seq, next_seq, next_ts, first_ts, poll_no)."""
    each = snapshots.select("robot_id", "poll_seq", "poll_ts").distinct()
    tl = Timeline.of(each, "robot_id", "poll_seq")
    each = tl.previous(each, {"prev_seq": "poll_seq"})
    each = tl.following(each, {"next_seq": "poll_seq", "next_ts": "poll_ts"})
    return tl.running(each, {"first_ts": ("first", F.col("poll_ts")), "poll_no": ("count", F.col("poll_seq"))})


def node_histories(snapshots: DataFrame) -> Timeline:
    """Sizes of all (robot, node) histories, measured once for every step."""
    return Timeline.of(snapshots, ("robot_id", "node"), ("poll_ts", "poll_seq"))


def graph_diff(snapshots: DataFrame, tl: Timeline | None = None) -> DataFrame:
    """(robot_id, poll_seq, poll_ts, node, change): ``joined`` or ``exited`` against the poll before.

    Presence is compared along each (robot, node) rather than poll by poll, so
    no task holds more than one node's history.
    """
    present = snapshots.select("robot_id", "poll_seq", "node").distinct()
    known = present.join(polls(snapshots), ["robot_id", "poll_seq"])
    tl = tl or node_histories(snapshots)
    seen = tl.following(tl.previous(known, {"_before": "poll_seq"}), {"_after": "poll_seq"})
    joined = F.col("prev_seq").isNotNull() & ~F.col("_before").eqNullSafe(F.col("prev_seq"))
    exited = F.col("next_seq").isNotNull() & ~F.col("_after").eqNullSafe(F.col("next_seq"))
    change = F.filter(
        F.array(
            F.when(joined, F.struct("poll_seq", "poll_ts", F.lit("joined").alias("change"))),
            F.when(
                exited,
                F.struct(F.col("next_seq").alias("poll_seq"), F.col("next_ts").alias("poll_ts"), F.lit("exited").alias("change")),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    return seen.select("robot_id", "node", F.explode(change).alias("_c")).select(
        "robot_id", "_c.poll_seq", "_c.poll_ts", "node", "_c.change"
    )


def not_whitelisted(df: DataFrame, whitelist: DataFrame, node: str = "node") -> DataFrame:
    names = whitelist.select(F.col("name").alias("_short"))
    return df.withColumn("_short", short_name(F.col(node))).join(names, "_short", "left_anti").drop("_short")


def baseline_split(snapshots: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Nodes of each robot's first poll with ``trusted`` true or false."""
    first = snapshots.join(
        snapshots.groupBy("robot_id").agg(F.min("poll_seq").alias("poll_seq")), ["robot_id", "poll_seq"], "left_semi"
    )
    names = whitelist.select(F.col("name").alias("_short"), F.lit(True).alias("_ok")).distinct()
    return (
        first.select("robot_id", "poll_seq", "poll_ts", "node").distinct()
        .withColumn("_short", short_name(F.col("node")))
        .join(names, "_short", "left")
        .select("robot_id", "poll_seq", "poll_ts", "node", F.coalesce("_ok", F.lit(False)).alias("trusted"))
    )


def grace_absorb(joins: DataFrame, starts: DataFrame, whitelist: DataFrame, seconds: float = GRACE_S) -> DataFrame:
    """Adds ``absorbed``: a whitelisted joiner within ``seconds`` of the robot's first poll."""
    names = whitelist.select(F.col("name").alias("_short"), F.lit(True).alias("_ok")).distinct()
    begin = starts.groupBy("robot_id").agg(F.min("poll_ts").alias("_first"))
    young = F.unix_micros("poll_ts") - F.unix_micros("_first") < int(seconds * 1e6)
    return (
        joins.join(begin, "robot_id")
        .withColumn("_short", short_name(F.col("node")))
        .join(names, "_short", "left")
        .withColumn("absorbed", F.coalesce("_ok", F.lit(False)) & young)
        .drop("_short", "_ok", "_first")
    )


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("robot_id", "poll_seq").agg(F.countDistinct("node").alias("live_nodes"))


def alert_once(joins: DataFrame, ttl: float = ALERT_TTL_S, exits: DataFrame | None = None, tl: Timeline | None = None) -> DataFrame:
    """One alert per (robot, node) and ``ttl``; an exit, when given, re-arms it.

    Rows are (robot_id, node, poll_ts, poll_seq, ...).
    """
    tl = tl or node_histories(joins)
    if exits is None:
        return thin(joins, tl, ttl)
    gone = exits.select("robot_id", "node", "poll_ts", "poll_seq").withColumn("_exit", F.lit(1))
    line = joins.unionByName(gone, allowMissingColumns=True)
    lives = tl.running(line, {"_life": ("count", F.col("_exit"))}).where("_exit is null").drop("_exit")
    return thin(lives, tl.within("_life"), ttl).drop("_life")


def node_events(snapshots: DataFrame, whitelist: DataFrame, tl: Timeline | None = None) -> DataFrame:
    """Join and exit events of unknown nodes as the monitor sees them.

    After the first poll only trusted nodes are known, so unknown nodes of poll
    1 count as joining at poll 1 and again at poll 2 and cannot exit at poll 2.
    """
    strangers = not_whitelisted(snapshots, whitelist)
    numbered = polls(snapshots).select("robot_id", "poll_seq", "poll_no")
    here = strangers.select("robot_id", "poll_seq", "poll_ts", "node").distinct().join(numbered, ["robot_id", "poll_seq"])
    early = here.where("poll_no <= 2").select("robot_id", "poll_seq", "poll_ts", "node", F.lit("joined").alias("change"))
    later = not_whitelisted(graph_diff(snapshots, tl), whitelist).join(numbered, ["robot_id", "poll_seq"]).where("poll_no > 2")
    return early.unionByName(later.select(*early.columns))


def node_monitor(snapshots: DataFrame, whitelist: DataFrame, ttl: float = ALERT_TTL_S, exit_alerts: bool = False) -> DataFrame:
    """(robot_id, poll_ts, poll_seq, node, alert, live_nodes) join and exit alerts."""
    tl = node_histories(snapshots)
    events = node_events(snapshots, whitelist, tl)
    joins, exits = events.where("change = 'joined'"), events.where("change = 'exited'")
    alerts = alert_once(joins, ttl, exits if exit_alerts else None, tl)
    if exit_alerts:
        alerts = alerts.unionByName(exits)
    return alerts.withColumnRenamed("change", "alert").join(snapshot_totals(snapshots), ["robot_id", "poll_seq"], "left")


def _rank(topics=WATCHED_TOPICS):
    out = F.lit(None).cast("int")
    for i, t in enumerate(topics):
        out = F.when(F.col("topic") == t, F.lit(i)).otherwise(out)
    return out


def unauthorised_publishers(publishers: DataFrame, allow: DataFrame, topics=WATCHED_TOPICS, shown: int | None = None) -> DataFrame:
    """(robot_id, tick_ts, topic, nodes): first watched topic with unlisted publishers.

    With ``shown`` at most so many names are listed, in order, and ``more`` counts the rest.
    """
    strangers = (
        publishers.where((F.col("node_name") != UNKNOWN_PUBLISHER) & F.col("topic").isin(*topics))
        .join(allow.select("topic", "node_name"), ["topic", "node_name"], "left_anti")
    )
    if shown is not None:
        # names are counted before they are ranked: a flood under one name is one row
        counted = strangers.groupBy("robot_id", "tick_ts", "topic", "node_name").agg(F.count(F.lit(1)).alias("_n"))
        ahead = W.partitionBy("robot_id", "tick_ts", "topic").orderBy("node_name")
        ranked = counted.withColumn("_before", F.coalesce(F.sum("_n").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        listed = F.when(F.col("_before") < shown, F.struct("node_name", F.least(F.col("_n"), shown - F.col("_before")).cast("int").alias("n")))
        bags = ranked.groupBy("robot_id", "tick_ts", "topic").agg(F.array_sort(F.collect_list(listed)).alias("_l"), F.sum("_n").alias("_total"))
        bags = bags.withColumn("nodes", F.flatten(F.transform("_l", lambda x: F.array_repeat(x["node_name"], x["n"])))).withColumn("more", F.col("_total") - F.size("nodes"))
        first = bags.groupBy("robot_id", "tick_ts").agg(F.min_by(F.struct("topic", "nodes", "more"), _rank(topics)).alias("_b"))
        return first.select("robot_id", "tick_ts", "_b.topic", "_b.nodes", "_b.more")
    bad = (
        strangers
        .groupBy("robot_id", "tick_ts", "topic")
        .agg(F.array_sort(F.collect_list("node_name")).alias("nodes"))
    )
    first = bad.groupBy("robot_id", "tick_ts").agg(F.min_by(F.struct("topic", "nodes"), _rank(topics)).alias("_b"))
    return first.select("robot_id", "tick_ts", "_b.topic", "_b.nodes")


def publisher_multiplicity(publishers: DataFrame, topics=WATCHED_TOPICS) -> DataFrame:
    """(robot_id, tick_ts, topic, publishers): topics with two or more live publishers.

    Names are not made distinct: two publishers under one name are the attack.
    """
    own = (F.col("topic") == "/cmd_vel") & F.col("node_name").isin(*SECURITY_NODES)
    return (
        publishers.where((F.col("node_name") != UNKNOWN_PUBLISHER) & F.col("topic").isin(*topics) & ~own)
        .groupBy("robot_id", "tick_ts", "topic")
        .agg(F.count(F.lit(1)).alias("publishers"))
        .where("publishers >= 2")
    )


def publisher_alarm(publishers: DataFrame, allow: DataFrame, topics=WATCHED_TOPICS) -> DataFrame:
    """(robot_id, tick_ts, d4_info): names are judged before counts."""
    names = unauthorised_publishers(publishers, allow, topics).select(
        "robot_id", "tick_ts",
        F.concat(F.col("topic"), F.lit(" unlisted: "), F.array_join("nodes", ",")).alias("_names"),
    )
    counts = publisher_multiplicity(publishers, topics).groupBy("robot_id", "tick_ts").agg(
        F.min_by(F.concat(F.col("topic"), F.lit(" publishers: "), F.col("publishers").cast("string")), _rank(topics)).alias("_counts")
    )
    return names.join(counts, ["robot_id", "tick_ts"], "full").select(
        "robot_id", "tick_ts", F.coalesce("_names", "_counts").alias("d4_info")
    )
