"""File integrity: sidecar signatures, verdicts, load policy, key fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.crypto import fingerprint, hmac_sha256

SIDECAR = ".sha256.hmac"


def sign_artifacts(files: DataFrame, key: bytes) -> DataFrame:
    """(path, sidecar) for files given as (path, content binary)."""
    return files.select(
        F.concat("path", F.lit(SIDECAR)).alias("path"), hmac_sha256(F.col("content"), key, binary=True).alias("sidecar")
    )


def with_sidecars(listing: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Joins ``binaryFile`` rows with the sidecar text found beside them, or with given ``notes`` (path, sidecar)."""
    if notes is None:
        notes = listing.where(F.col("path").endswith(SIDECAR)).select(
            F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"),
            F.trim(F.col("content").cast("string")).alias("sidecar"),
        )
    return listing.where(~F.col("path").endswith(SIDECAR)).join(notes, "path", "left")


def hashed(files: DataFrame, key: bytes) -> DataFrame:
    """(path, expected): the keyed hash of each file's content."""
    return files.select("path", hmac_sha256(F.col("content"), key, binary=True).alias("expected"))


def verdict_of(expected: Column, sidecar: Column) -> Column:
    """ok, tampered, unsigned, or too_large where content was not readable."""
    return F.when(expected.isNull(), "too_large").when(sidecar.isNull(), "unsigned").when(sidecar == expected, "ok").otherwise("tampered")


def verify_artifacts(files: DataFrame, key: bytes) -> DataFrame:
    """Adds ``verdict``: ok, tampered, unsigned, or too_large where content was not readable."""
    return files.withColumn("verdict", verdict_of(hmac_sha256(F.col("content"), key, binary=True), F.col("sidecar")))


def load_policy(verdict: Column, strict: bool) -> Column:
    """load / warn / refuse for a verdict."""
    unsigned = F.lit("refuse" if strict else "warn")
    return F.when(verdict == "ok", "load").when(verdict == "unsigned", unsigned).otherwise("refuse")


def key_fingerprints(nodes: DataFrame, secret: Column, length: int = 16) -> DataFrame:
    return nodes.withColumn("fingerprint", fingerprint(secret, length))


def fingerprint_agreement(nodes: DataFrame, robot: str = "robot_id") -> DataFrame:
    """Per robot: number of nodes and whether all hold the same key."""
    return nodes.groupBy(robot).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.min("fingerprint").eqNullSafe(F.max("fingerprint")).alias("same_key"),
    )
