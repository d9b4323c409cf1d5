"""Signed envelopes: signing, the ordered checks, replay refusal, impostors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.crypto import hmac_sha256
from ..functions.scan import bind
from ..plans.replay import thin
from ..plans.timeline import Timeline, axis_of, rows_per_task
from ..session import checkpointed

# The six channels, the topics that carry them, and how old a
# message may be per receiver (seconds).
CHANNELS = ("alerts", "heartbeat", "patrol/goto", "sensor/status", "mission/cmd", "system/health")
TOPIC_CHANNEL = {
    "/security/alerts": "alerts",
    "/security/heartbeat": "heartbeat",
    "/patrol/goto": "patrol/goto",
    "/sensor/status": "sensor/status",
    "/mission/cmd": "mission/cmd",
    "/system/health": "system/health",
}
MAX_AGE_S, CLOCK_SKEW_S, REPLAY_TTL_S = 10.0, 2.0, 12.0
CHANNEL_MAX_AGE_S = {"heartbeat": 3.0, "sensor/status": 5.0, "mission/cmd": 5.0}


def expected_channel(topic: Column) -> Column:
    pairs = [F.lit(x) for pair in TOPIC_CHANNEL.items() for x in pair]
    return F.element_at(F.create_map(*pairs), topic)


def channel_max_age(channel: Column) -> Column:
    out = F.lit(MAX_AGE_S)
    for name, age in CHANNEL_MAX_AGE_S.items():
        out = F.when(channel == name, F.lit(age)).otherwise(out)
    return out


def sign(df: DataFrame, key: bytes, payload: Column, channel: Column, ts: Column, nonce: Column | None = None) -> DataFrame:
    """Adds ``raw``, the signed envelope text.

    Without ``nonce`` a random one is drawn, which is not replay-stable; streams
    and repeatable jobs pass a column.
    """
    drawn = F.substring(F.sha2(F.expr("uuid()"), 256), 1, 16) if nonce is None else nonce
    body = F.to_json(F.struct(channel.alias("channel"), drawn.alias("nonce"), payload.alias("payload"), ts.alias("ts")))
    with_body = df.withColumn("_body", body)
    raw = F.to_json(F.struct(F.col("_body").alias("body"), hmac_sha256(F.col("_body"), key).alias("sig")))
    return with_body.withColumn("raw", raw).drop("_body")


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _text(v: Column, field: str) -> Column:
    return F.when(_kind(v, field) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))


def _number(v: Column, field: str) -> Column:
    kind = _kind(v, field)
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, f"$.{field}", "double"))


def is_fresh(ts: Column, now_s: Column, max_age: Column | float = MAX_AGE_S, skew: float = CLOCK_SKEW_S) -> Column:
    """Both ends count as fresh; NaN does not."""
    age = F.lit(max_age) if not isinstance(max_age, Column) else max_age
    return ts.between(now_s - age, now_s + skew)


def inspect(df: DataFrame, key: bytes, expected: Column, max_age: Column | float = MAX_AGE_S,
            skew: float = CLOCK_SKEW_S, recv_ts: str = "recv_ts") -> DataFrame:
    """Adds ``payload, nonce, channel, sent_s, reject_reason`` (null = accepted).

    Checks run in the order format, signature, types, channel, stale. Replay is
    decided by ``verify``, which sees more than one row. All steps are bound
    inside one expression: as separate columns, a filter on the reason would be
    pushed down with every step written out many times over.
    """
    now_s = axis_of(df, recv_ts) / 1e6

    def judge(env: Column) -> Column:
        e = env["e"]
        b = env["b"]
        reason = (
            F.when(e["body"].isNull() | e["sig"].isNull(), "format")
            .when(hmac_sha256(e["body"], key) != e["sig"], "signature")
            .when(b["payload"].isNull() | b["nonce"].isNull() | b["channel"].isNull() | b["sent_s"].isNull(), "types")
            .when(~b["channel"].eqNullSafe(expected), "channel")
            .when(~is_fresh(b["sent_s"], now_s, max_age, skew), "stale")
        )
        return F.struct(b["payload"].alias("payload"), b["nonce"].alias("nonce"), b["channel"].alias("channel"),
                        b["sent_s"].alias("sent_s"), reason.alias("reject_reason"))

    def inner(e: Column) -> Column:
        body = bind(
            F.try_parse_json(e["body"]),
            lambda v: F.struct(_text(v, "payload").alias("payload"), _text(v, "nonce").alias("nonce"),
                               _text(v, "channel").alias("channel"), _number(v, "ts").alias("sent_s")),
        )
        return bind(F.struct(e.alias("e"), body.alias("b")), judge)

    outer = bind(
        F.try_parse_json(F.col("raw")), lambda v: F.struct(_text(v, "body").alias("body"), _text(v, "sig").alias("sig"))
    )
    return df.withColumn("_c", bind(outer, inner)).select(*df.columns, "_c.*")


def drop_replays(df: DataFrame, keys=("receiver", "nonce"), ttl: float = REPLAY_TTL_S, order=("recv_ts", "seq"),
                 mark: str | None = None, eligible: Column | None = None, tl: Timeline | None = None) -> DataFrame:
    """First copy wins; a refused copy does not extend the expiry.

    A nonce is a random 64-bit value per message, so groups are the copies of
    one message; a flood of copies is cut along time like any large key.
    """
    tl = tl or Timeline.of(df, keys, order)
    return thin(df, tl, ttl, mark=mark, eligible=eligible)


def verify(df: DataFrame, key: bytes, expected: Column, max_age: Column | float = MAX_AGE_S, skew: float = CLOCK_SKEW_S,
           keys=("receiver", "nonce"), ttl: float = REPLAY_TTL_S, order=("recv_ts", "seq")) -> DataFrame:
    """All six checks; ``reject_reason`` ends with ``replay``.

    Messages are inspected once and walked once, in the order of their copies.
    Only if some text stands more often than a task should hold, groups of
    copies are measured and cut; that is told from a hash of the text, without
    parsing it.
    """
    limit = rows_per_task(df)
    flood = df.groupBy(*[k for k in keys if k in df.columns], F.xxhash64("raw").alias("_h")).count().where(F.col("count") > limit)
    tl = Timeline(tuple(keys), tuple(order), limit=limit)
    if not flood.isEmpty():
        nonce = F.get_json_object(F.get_json_object("raw", "$.body"), "$.nonce")
        tl = Timeline.of(df.withColumn("nonce", nonce), keys, order)
    seen = inspect(df, key, expected, max_age, skew, order[0])
    marked = drop_replays(seen, keys, ttl, order, "_first", F.col("reject_reason").isNull(), tl)
    reason = F.coalesce("reject_reason", F.when(~F.col("_first"), F.lit("replay")))
    return marked.withColumn("reject_reason", reason).drop("_first")


def impostor_messages(verified: DataFrame, own: DataFrame, nonce: str = "nonce") -> DataFrame:
    """Accepted messages whose nonce we never sent."""
    return verified.where(F.col("reject_reason").isNull()).join(own.select(nonce), nonce, "left_anti")


def rejections(verified: DataFrame, seconds: float = 5.0, key: str = "receiver", order=("recv_ts", "seq"),
               strict: bool = False) -> DataFrame:
    """One row per throttled report: its time and how many refusals it covers.

    A report goes out for the first refusal and then at most every
    ``seconds``; refusals in between are counted into the next report. The
    refusals' times are written once, as verifying is dear and they are read
    several times.
    """
    bad = checkpointed(verified.where(F.col("reject_reason").isNotNull()).select(key, *order))
    tl = Timeline.of(bad, key, order)
    marked = thin(bad, tl, seconds, strict=strict, mark="_report")
    before = tl.running(marked, {"_seg": ("count", F.when(F.col("_report"), 1))}, before=True)
    per = before.groupBy(key, "_seg").agg(
        F.count(F.lit(1)).alias("refused"), F.max(F.when(F.col("_report"), F.col(order[0]))).alias("report_ts")
    )
    return per.where(F.col("report_ts").isNotNull()).select(key, "report_ts", "refused")


__all__ = ["sign", "inspect", "verify", "drop_replays", "impostor_messages", "rejections", "expected_channel",
           "channel_max_age", "is_fresh", "CHANNELS", "TOPIC_CHANNEL"]
