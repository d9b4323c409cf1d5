"""Suffix-array dedup: every byte of a long string that stands anywhere else goes, over whole texts and all documents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .anchors import WINDOW, anchors
from .common import row_of, saved, small_batches
from .lines import row_keys
from .suffixes import maximal_repeats

#: Strings around equal anchors that one suffix array may hold; families beyond are divided by their contents.
FAMILY = 500
#: Bytes of families that share one suffix array; the step in which large families are divided.
ARRAY_BYTES, STEP = 1 << 20, 16
BATCH = 256


def anchor_table(texts: DataFrame) -> DataFrame:
    """(g, s, t, k1, k2, start, n, times, lead) of (k1, k2, text): see :func:`anchors.anchors`."""
    def run(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(*a[:3], x, y, *a[3:]) for x, y, text in zip(k1, k2, batch.column(2).to_pylist()) if text for a in anchors(text.encode("utf-8", "replace"))]
            columns = list(zip(*rows)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", "s", "t", "k1", "k2", "start", "n", "times", "lead"])

    small_batches(texts.sparkSession, BATCH)
    return texts.mapInArrow(run, "g long, s long, t long, k1 long, k2 long, start long, n long, times long, lead long")


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, s, t, copies, n, lead, many, bytes) of one place of each wanted string."""
    per_row = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "s", "t", "copies", "n", "lead", "many", "start")).alias("wanted"))
    both = texts.join(per_row.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted")

    def run(batches):
        for batch in batches:
            out = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                out += [(w["g"], w["s"], w["t"], w["copies"], w["n"], w["lead"], w["many"], data[w["start"] : w["start"] + w["n"] + WINDOW - 1]) for w in rows]
            columns = list(zip(*out)) or [[]] * 8
            types = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["g", "s", "t", "copies", "n", "lead", "many", "bytes"])

    return both.mapInArrow(run, "g long, s long, t long, copies long, n long, lead long, many boolean, bytes binary")


RANGE = "g long, s long, t long, first long, last long"
RANGE_NAMES = ["g", "s", "t", "first", "last"]


def _array_ranges(strings: DataFrame) -> DataFrame:
    """(g, s, t, first, last): windows of each string of small families that stand elsewhere, from the families' suffix arrays."""
    def ranges(family):
        groups = maximal_repeats([f[3] for f in family], WINDOW, max(len(f[3]) for f in family))
        places = sorted({(i, p, p + length - WINDOW) for length, owner, place in groups for i, p in zip(owner.tolist(), place.tolist())})
        runs: list[list[int]] = []
        for i, first, last in places:  # repeats within and beside each other make one run of starts
            if runs and runs[-1][0] == i and first <= runs[-1][2] + 1:
                runs[-1][2] = max(runs[-1][2], last)
            else:
                runs.append([i, first, last])
        return {(*family[i][:3], first, last) for i, first, last in runs}

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            out = set()
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > ARRAY_BYTES and row[0] != last:
                    out |= ranges(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], RANGE_NAMES)
        if held and (out := ranges(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], RANGE_NAMES)

    dealt = strings.select("g", "s", "t", "bytes").repartition("g").sortWithinPartitions("g", "s", "t")
    return dealt.mapInArrow(run, RANGE)


PIECE_NAMES = ["g", "s", "t", "copies", "block", "place", "count", "ca", "cb", "wa", "wb", "first"]


def _halves(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(data)
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def _pieces(strings: DataFrame, step: int) -> DataFrame:
    """Windows of large families' strings (those of ``parts``) by blocks of ``step`` places from the anchor.

    A piece is what one string has in a block. It comes with hashes of the
    bytes that all windows of the block have in common, whichever of them the
    string has, and of all bytes that the piece covers. Equal windows are in
    the same block and share the former.
    """
    def run(batches):
        for batch in batches:
            out = []
            for g, s, t, copies, lead, data, parts in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for part in parts:
                    j, end = part["first"], part["first"] + part["count"]
                    while j < end:
                        place = lead - j
                        block = place // step
                        count = min(place - block * step + 1, end - j)
                        at = lead - block * step
                        core = _halves(data[at : at - step + 1 + WINDOW])
                        out.append((g, s, t, copies, block, place, count, *core, *(core if step == 1 else _halves(data[j : j + count - 1 + WINDOW])), j))
                        j += count
            columns = list(zip(*out)) or [[]] * len(PIECE_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECE_NAMES)

    return strings.select("g", "s", "t", "copies", "lead", "bytes", "parts").mapInArrow(run, ", ".join(f"{n} long" for n in PIECE_NAMES))


def _judged(pieces: DataFrame) -> DataFrame:
    """The pieces whose common bytes stand elsewhere too, with ``same``: whether all of them cover the same."""
    key = ["g", "block", "ca", "cb"]
    cover = F.struct("wa", "wb", "place", "count")
    kinds = pieces.groupBy(*key).agg(F.sum("copies").alias("total"), (F.min(cover) == F.max(cover)).alias("same")).where("total > 1").drop("total")
    return pieces.join(kinds, key)


def _divided_ranges(strings: DataFrame) -> DataFrame:
    """The same as :func:`_array_ranges` for large families, by counting: runs of windows first, single ones where runs differ."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("count")))
    runs = saved(_judged(saved(_pieces(strings.withColumn("parts", whole), STEP), "window-runs")), "judged-runs")
    sure = runs.where("same").select("g", "s", "t", "first", (F.col("first") + F.col("count") - 1).alias("last"))
    parts = runs.where("NOT same").groupBy("g", "s", "t").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    single = _judged(saved(_pieces(strings.join(parts, ["g", "s", "t"]), 1), "single-windows"))
    return sure.unionByName(single.select("g", "s", "t", "first", F.col("first").alias("last")))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(k1, k2, found): runs (first, last) of starts of WINDOW-byte strings that stand anywhere else, in one or more rows.

    Equal strings have equal anchors and lie equally around them, so only
    strings of one family (anchor) need comparing. A string that stands several
    times is repeated all through; the others of its family are compared by
    the family's suffix array, or by counting where a family is large.
    """
    every = saved(anchor_table(texts), "anchors")
    twice = every.groupBy("g").agg(F.sum("times").alias("n")).where("n > 1").select("g")
    some = saved(every.join(twice.hint("shuffle_hash"), "g"), "shared-anchors")
    kinds = some.groupBy("g", "s", "t").agg(F.sum("times").alias("copies"), F.min(F.struct("k1", "k2", "start", (F.col("n") / F.col("times")).cast("long").alias("n"), "lead")).alias("at"))
    kinds = saved(kinds, "strings")
    families = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("copies") == 1, 1)).alias("once")).where("kinds > 1 AND once > 0")
    wanted = kinds.join(families, "g").select("g", "s", "t", "copies", "at.*", (F.col("kinds") > FAMILY).alias("many"))
    strings = saved(_fetched(texts, wanted), "open-strings")
    ranges = _array_ranges(strings.where("NOT many")).unionByName(_divided_ranges(strings.where("many")))
    ranges = ranges.groupBy("g", "s", "t").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    once = kinds.where("copies = 1").select("g", "s", "t", "at.k1", "at.k2", "at.start").join(ranges, ["g", "s", "t"])
    moved = F.transform("found", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"]).alias("last")))
    often = some.join(kinds.where("copies > 1").select("g", "s", "t"), ["g", "s", "t"], "left_semi")
    all_of_it = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
    return once.select("k1", "k2", moved.alias("found")).unionByName(often.select("k1", "k2", all_of_it.alias("found")))


def spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of bytes covered by windows that start in the ranges."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + WINDOW)
        else:
            out.append([first, last + WINDOW])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a 400-byte string that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256, and with ``keep_bytes`` the remaining ``kept`` bytes and
    ``removed``, the runs as (begin, end). Texts count as UTF-8 bytes; strings
    are judged on the input and never reach over two documents; overlapping
    ones count. Null and empty texts have no bytes; null ids are kept; rows
    equal in id and text are documents of their own and so repeat each other;
    other columns are ignored; an empty table gives an empty result.
    """
    k1, k2 = row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    source = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = saved(repeated_windows(source.select("k1", "k2", "text")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("found")).alias("found")), "repeated")
    both = source.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "found")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, removed array<struct<begin:long,end:long>>" if keep_bytes else "")

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                gone = spans([(r["first"], r["last"]) for r in found or ()])
                at, parts = 0, []
                for begin, end in gone:
                    parts.append(data[at:begin])
                    at = end
                kept = b"".join([*parts, data[at:]])
                row = (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [{"begin": b, "end": e} for b, e in gone]) if keep_bytes else row)
            types = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out)) or [[]] * (6 if keep_bytes else 4)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names[: len(arrays) + 1])

    return both.mapInArrow(run, schema)
