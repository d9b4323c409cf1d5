"""Secret scans: base patterns, and weak credential parts reported only where their counterparts stand near."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import saved, small_batches
from .lines import row_keys

#: Start distance, in code points, within which parts belong to one scope.
SCOPE = 400

#: The base patterns. Kinds stand in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]

#: Weak parts: identifiers, secrets and endpoints that prove nothing alone.
WEAK_ID = re.compile(r"""\b(?:(?:client|account|tenant|access|user|app)[_-]?(?:id|key|name)|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|sftp)://[^\s"'<>]+|\bendpoint["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+""", re.I | re.A)
#: Hosts of these clouds: labels, one of the names, com. A run of host characters is found first, so long ones cost no more than their length.
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+){2,}", re.I | re.A)
CLOUD = re.compile(r"\.(?:amazonaws|azure|googleapis)\.com\b", re.I | re.A)
EDGE = re.compile(r"\b(?=[a-z0-9-])", re.I | re.A)


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, values of ``endpoint`` and cloud hosts, leftmost first and without overlap."""
    found = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    clouds = [(m.start(), m.end()) for m in CLOUD.finditer(text)]
    if clouds:
        starts = [s for s, _ in clouds]
        for m in HOST.finditer(text):
            i = bisect_left(starts, m.end()) - 1
            if i >= 0 and clouds[i][0] > m.start():
                begin = EDGE.search(text, m.start(), clouds[i][0])
                if begin:
                    found.append((begin.start(), clouds[i][1]))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _random_looking(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def weak_parts(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak parts that no base span overlaps."""
    found = [(m.start(), "weak_id", m.end()) for m in WEAK_ID.finditer(text)]
    found += [(m.start(), "weak_secret", m.end()) for m in WEAK_SECRET.finditer(text) if _random_looking(m[0])]
    found += [(s, "endpoint", e) for s, e in endpoints(text)]
    found.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max, initial=0))
    return [(s, k, e) for s, k, e in found if reach[bisect_left(starts, e)] <= s]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])


def parts_of(docs: DataFrame) -> DataFrame:
    """Base spans and weak parts of each whole text of (k1, k2, doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:bigint,kind:string,end:bigint>>"
    schema = f"k1 bigint, k2 bigint, doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base {span}, weak {span}"

    def rows(spans):
        return [{"start": s, "kind": k, "end": e} for s, k, e in spans]

    def run(batches):
        for batch in batches:
            counts, shas, bases, weaks = [[], [], []], [], [], []
            for text in batch.column(3).to_pylist():
                base = base_spans(text) if text else []
                for out, kind in zip(counts, KINDS):
                    out.append(sum(k == kind for _, k, _ in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                bases.append(rows(base))
                weaks.append(rows(weak_parts(text, base)) if text else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(bases, pa.list_(SPAN)), pa.array(weaks, pa.list_(SPAN))],
                ["k1", "k2", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, linked): the weak parts whose counterparts start within ``scope`` of them.

    An identifier needs a secret (weak or base), a secret an identifier (weak or
    an access key), an endpoint both. The interval join is by cells of ``scope``
    characters: of each cell and role only the first and last start matter to
    the cells beside it, so a dense text makes no pairs.
    """
    every = (found.where(F.size("weak") > 0).select("k1", "k2", F.explode(F.concat("base", "weak")).alias("p"))
             .select("k1", "k2", F.col("p.start").alias("start"), F.col("p.kind").alias("kind"), F.col("p.end").alias("end"))
             .withColumn("cell", F.floor(F.col("start") / scope)))
    is_id, is_secret = F.col("kind").isin("access", "weak_id"), F.col("kind").isin("assign", "hex", "weak_secret")
    ends = every.groupBy("k1", "k2", "cell").agg(*(f(F.when(c, F.col("start"))).alias(f"{n}_{r}") for r, c in (("id", is_id), ("secret", is_secret)) for n, f in (("first", F.min), ("last", F.max))))
    beside = ends.select("k1", "k2", F.explode(F.array(*(F.struct((F.col("cell") + d).alias("cell"), *((F.col(f"last_{r}") if d == 1 else F.col(f"first_{r}")).alias(f"{r}{d + 1}") if d == x else F.lit(None).cast("long").alias(f"{r}{x + 1}") for r in ("id", "secret") for x in (-1, 0, 1))) for d in (-1, 0, 1)))).alias("b")).select("k1", "k2", "b.*")
    seen = beside.groupBy("k1", "k2", "cell").agg(*(F.max(f"{r}{x}").alias(f"{r}{x}") for r in ("id", "secret") for x in (0, 1, 2)))
    weak = every.where(F.col("kind").isin("weak_id", "weak_secret", "endpoint"))

    def near(role):
        before, here, after = F.col(f"{role}2"), F.col(f"{role}1"), F.col(f"{role}0")
        return here.isNotNull() | F.coalesce(before >= F.col("start") - scope, F.lit(False)) | F.coalesce(after <= F.col("start") + scope, F.lit(False))

    ok = F.when(F.col("kind") == "weak_id", near("secret")).when(F.col("kind") == "weak_secret", near("id")).otherwise(near("id") & near("secret"))
    return weak.join(seen, ["k1", "k2", "cell"]).where(ok).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text.

    Returns per input row doc_id, n_assign, n_access, n_hex, base_sha256 and
    spans (``kind:start:end`` in code points, end exclusive, by start and then
    kind in the order of KINDS); base spans are always among them, weak parts
    only with their counterparts. Null and empty texts have no spans; null ids
    are kept; rows equal in id and text are scanned alike; other columns are
    ignored; an empty table gives an empty result.
    """
    k1, k2 = row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    source = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = saved(parts_of(source), "secret-parts")
    both = found.join(linked_parts(found, scope), ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    order = F.array(*map(F.lit, KINDS))
    listed = F.array_sort(F.transform(F.concat("base", F.coalesce("linked", none)), lambda p: F.struct(p["start"].alias("s"), F.array_position(order, p["kind"]).alias("o"), p["kind"].alias("k"), p["end"].alias("e"))))
    spans = F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p["k"], p["s"], p["e"])), ",")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))
