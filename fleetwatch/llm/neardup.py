"""Near duplicates: SuperMinHash signatures, banding, confirmation on full shingle sets, union-find groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dealt, saved, small_batches
from .components import components
from .shingles import mix, shingle_set

BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: Links have 100 * shared >= percent * united shingles, by default this.
PERCENT = 85
#: Slots in which two linked documents surely agree: six standard errors below the 68 expected at 85 of 100.
LEAST_AGREED = 49
#: Shingles of the members that one task compares with as many others.
BLOCK_SHINGLES = 200_000
BATCH = 256


def super_min_hash(items: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a set of 64-bit hashes: per slot the least ``step + random``, as step << 32 | random bits.

    Every element has its own permutation of the slots, drawn step by step: at
    step j it offers j plus a random fraction to the j-th slot of it. All
    elements take step j together, and no further step once every slot holds
    less than j + 1: later offers can't be smaller. The least offers don't
    depend on the elements' order.
    """
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    n = len(items)
    if not n:
        return best
    with np.errstate(over="ignore"):
        order = None
        rows = np.arange(n)
        for j in range(slots):
            drawn = mix(items + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))
            offer = np.uint64(j) << np.uint64(32) | drawn >> np.uint64(32)
            at = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            if order is None:
                slot = at
            else:
                slot = order[rows, at]
            np.minimum.at(best, slot, offer)
            if int(best.max()) >> 32 <= j:
                break
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (n, 1))
            order[rows, at] = order[:, j]
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    """16 bits of each slot, four slots packed into one key: the keys together are the signature that is kept."""
    return np.ascontiguousarray(mix(signature).astype(np.uint16)).view(np.int64)


def signatures(docs: DataFrame, count: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, f, g, bands) of (doc_id, text): set size, 128-bit fingerprint of the set, ``count`` band keys (null for empty sets)."""
    def run(batches):
        for batch in batches:
            n, f, g, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    g.append(int(mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(super_min_hash(s, count * ROWS)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f", "g", "bands"])

    small_batches(docs.sparkSession, BATCH)
    return docs.mapInArrow(run, "doc_id long, n_shingles long, f long, g long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough; ``texts`` is (cid, text)."""
    def run(batches):
        seen: tuple[str | None, np.ndarray] = (None, shingle_set(None))
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            ok = []
            for x, y in zip(left, right):
                if x != seen[0]:
                    seen = (x, shingle_set(x))
                other = shingle_set(y)
                shared = len(np.intersect1d(seen[1], other, assume_unique=True))
                ok.append(100 * shared >= percent * (len(seen[1]) + len(other) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small_batches(pairs.sparkSession, BATCH)
    right = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("right")).hint("shuffle_hash"), "b")
    both = right.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("left")).hint("shuffle_hash"), "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _lanes(bands: pd.Series) -> np.ndarray:
    return np.stack(bands.to_numpy()).astype(np.int64).view(np.uint16).reshape(len(bands), -1)


def rest_links(members: DataFrame, texts: DataFrame, percent: int = PERCENT, least_agreed: int = LEAST_AGREED) -> DataFrame:
    """Links between components that meet in a bucket: every such pair is tested, none is written out.

    ``members`` is (band, key, leader, cid, component, bands, n_shingles) of
    buckets with more than one component. Of two linked members of a bucket at
    least one isn't in its largest component: those ("loose") meet the others
    in pairs of blocks that some bucket touches. Blocks hold about
    BLOCK_SHINGLES shingles, members of one family beside each other. A task
    tests pairs that share a band and agree in enough slots on their full sets.
    """
    sizes = members.groupBy("band", "key", "component").count()
    largest = sizes.groupBy("band", "key").agg(F.max(F.struct("count", "component"))["component"].alias("largest"))
    marked = members.join(dealt(largest), ["band", "key"])
    each = marked.groupBy("cid").agg(F.min("leader").alias("family"), F.first("component").alias("component"), F.first("bands").alias("bands"),
                                     F.first("n_shingles").alias("n"), F.max(F.col("component") != F.col("largest")).alias("loose"))
    each = saved(each, "open-members")
    parts = each.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    sub = F.pmod(F.xxhash64("cid"), F.greatest("parts", F.lit(1)))
    block = saved(each.join(dealt(parts), "family").select("cid", "loose", F.struct("family", sub.alias("sub")).alias("block")), "blocks")
    touched = marked.select("band", "key", "cid", (F.col("component") != F.col("largest")).alias("out")).join(dealt(block.select("cid", "block")), "cid")
    ones = touched.select("band", "key", F.col("block").alias("x")).distinct()
    loose = touched.where("out").select("band", "key", F.col("block").alias("y")).distinct()
    met = saved(ones.join(dealt(loose), ["band", "key"]).select("x", "y").distinct(), "block-pairs")
    schema = "cid long, items array<long>"

    def sets(batches):
        for batch in batches:
            items = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], ["cid", "items"])

    full = each.select("cid", "component", "bands").join(dealt(texts.join(dealt(each.select("cid")), "cid", "left_semi").select("cid", "text").mapInArrow(sets, schema)), "cid").join(dealt(block), "cid")
    full = saved(full, "open-sets")
    left = full.join(dealt(met), full["block"] == met["x"]).select("x", "y", "cid", "component", "bands", "items")
    right = full.where("loose").join(dealt(met), full["block"] == met["y"]).select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("cid").alias("cid2"), F.col("component").alias("component2"), F.col("bands").alias("bands2"), F.col("items").alias("items2"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            one, two = _lanes(a["bands"]), _lanes(b["bands2"])
            keys_one, keys_two = np.stack(a["bands"].to_numpy()), np.stack(b["bands2"].to_numpy())
            left_sets, right_sets = a["items"].to_numpy(), b["items2"].to_numpy()
            left_ids, right_ids = a["cid"].to_numpy(), b["cid2"].to_numpy()
            at_one, at_two = a["component"].to_numpy(), b["component2"].to_numpy()
            for at in range(len(b)):
                some = np.flatnonzero((keys_one == keys_two[at]).any(1) & (at_one != at_two[at]))
                some = some[(one[some] == two[at]).sum(1) >= least_agreed]
                for i in some:
                    n, m = len(left_sets[i]), len(right_sets[at])
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    shared = len(np.intersect1d(left_sets[i], right_sets[at], assume_unique=True))
                    if 100 * shared >= percent * (n + m - shared):
                        out.append((int(left_ids[i]), int(right_ids[at])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return left.groupBy("x", "y").cogroup(right.groupBy("u", "v")).applyInPandas(run, "a long, b long").distinct()


def consensus_pairs(members: DataFrame) -> DataFrame:
    """Per unresolved bucket: its members with the one whose slots agree best with each slot's commonest value."""
    lanes = members.select("band", "key", "cid", F.posexplode(F.flatten(F.transform("bands", lambda k: F.array(*(F.call_function("shiftright", k, F.lit(16 * r)).bitwiseAND(F.lit(0xFFFF)) for r in range(ROWS)))))).alias("slot", "value"))
    counts = lanes.groupBy("band", "key", "slot", "value").count()
    modal = counts.groupBy("band", "key", "slot").agg(F.max(F.struct("count", "value"))["value"].alias("modal"))
    score = lanes.join(dealt(modal), ["band", "key", "slot"]).groupBy("band", "key", "cid").agg(F.count(F.when(F.col("value") == F.col("modal"), 1)).alias("agreed"))
    centre = score.groupBy("band", "key").agg(F.max(F.struct("agreed", -F.col("cid"), "cid"))["cid"].alias("centre"))
    pairs = members.select("band", "key", "cid", "component").join(dealt(centre), ["band", "key"]).where("cid <> centre")
    return pairs.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct()


def groups(docs: DataFrame, report: dict | None = None, percent: int = PERCENT, bands: int = BANDS, least_agreed: int = LEAST_AGREED) -> DataFrame:
    """Near-duplicate groups of documents (doc_id long, text).

    Returns doc_id, n_shingles, component_id and kept, one row per input row.
    Documents with the same shingle set are one class, linked by that; classes
    are linked if 100 * shared >= ``percent`` * united shingles, confirmed on
    the full sets. Candidates share one of ``bands`` bands of four slots, and at
    last at least ``least_agreed`` slots; both have to suit the percentage, as
    the defaults suit 85. Within a bucket first the smallest id meets the others, then the most central member of buckets
    that still hold several components, then all that remains; pairs already in
    one component need no test, so no group is expanded into all its pairs.

    Null and empty texts have empty sets and stand alone. A null id stands
    alone too (component null, kept). Rows with equal ids are one node. An
    empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(signatures(source, bands), "signatures")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(named.groupBy("f", "g").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "classes")
    banded = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = saved(banded.join(dealt(shared.select("band", "key", "leader")), ["band", "key"]), "bucket-members")
    stars = saved(members.where("cid <> leader").groupBy(F.col("leader").alias("a"), F.col("cid").alias("b")).agg(F.count("*").alias("bands")), "stars")
    inner = members.select("cid").distinct()
    texts = saved(source.join(inner.withColumnRenamed("cid", "doc_id").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("cid"), "text"), "candidate-texts")
    best = stars.groupBy("b").agg(F.max(F.struct("bands", -F.col("a"), "a"))["a"].alias("a")).select("a", "b")
    links = saved(confirmed(best, texts, percent), "links")
    tried = best
    flat = classes.select(F.col("cid"))

    def labelled(links):
        found = components(links)
        return flat.join(dealt(found.withColumnRenamed("node", "cid")), "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"))

    def across(pairs, label):
        ends = [label.select(F.col("cid").alias(k), F.col("component").alias(f"component_{k}")) for k in ("a", "b")]
        return pairs.join(dealt(ends[0]), "a").join(dealt(ends[1]), "b").where("component_a <> component_b").select("a", "b")

    label = labelled(links)
    if report is not None:
        report |= {"classes": classes.count(), "members": inner.count(), "stars": stars.count(), "best": best.count(), "links": links.count()}
    for step in ("stars", "centres", "rest"):
        if step == "stars":
            more = across(stars.select("a", "b").join(dealt(tried), ["a", "b"], "left_anti"), label)
        else:
            open_ = members.join(dealt(label), "cid")
            mixed = open_.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key")
            open_ = saved(open_.join(dealt(mixed), ["band", "key"]).join(dealt(classes.select("cid", "bands", "n_shingles")), "cid"), "open-buckets")
            more = across(consensus_pairs(open_).join(dealt(tried), ["a", "b"], "left_anti"), label) if step == "centres" else None
        if more is not None:
            more = saved(more, "pairs")
            tried = tried.unionByName(more)
        new = saved(rest_links(open_, texts, percent, least_agreed) if more is None else confirmed(more, texts, percent), "links")
        if report is not None:
            report[step] = (0 if more is None else more.count(), new.count())
        if not new.isEmpty():
            links = links.unionByName(new)
            label = labelled(links)
    label = saved(label, "class-components")
    least = label.groupBy("component").agg(F.min("cid").alias("component_id"))
    class_of = classes.select("f", "g", "cid").join(dealt(label), "cid").join(dealt(least), "component").select("f", "g", "component_id")
    out = signed.join(dealt(class_of), ["f", "g"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, least_agreed: int = LEAST_AGREED) -> DataFrame:
    """The documents that :func:`groups` keeps, with all their columns."""
    gone = groups(docs, None, percent, bands, least_agreed).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
