"""Suffix-array dedup: depth-limited most-significant-digit passes over runs of suffixes.

A byte goes when a string of ``THRESHOLD`` bytes that covers it also starts anywhere else. Suffixes
need ordering only through that depth, and groups of suffixes that agree that far are the repeated
windows. A row for every suffix would be 14 times the input, so suffixes travel in runs and only those still
in question go on, one digit after the other; a digit partitions, and what is alone in its group is done:

1. The first digit is the window's smallest ``GRAM``-byte gram (by hash, leftmost); windows that
   share that gram at one place form a run and travel as one row. Runs whose gram occurs once are
   done: none of their windows repeats.
2. The next digit is the run's whole hull. Runs whose hull occurs again are done: all windows repeat.
3. Of each gram one run per different hull goes on, cut into spans of ``SPAN`` windows by place of the
   gram. The digit is what all windows of a span have in common; spans alone in it are done, and
   those whose hull occurs again are done the other way.
4. The last digit is the window itself, one span per different hull again; two or more repeat.

Digits are 64-bit hashes, and a group is what agrees in all digits so far: a false repeat takes an
equal hash within one of the small groups of an earlier digit, not anywhere in the corpus. Counting is
a partial aggregation, and counts are written before rows meet them, so that either side of the
equi-join is a plain shuffle that adaptive skew handling splits: one passage in a third of all documents does
not land in one task.

Defined results: null is the empty text; matches never cross documents; rows equal in doc_id and text
are two documents that repeat each other; texts under 400 bytes lose nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import RangeHash, release, stash, text_blocks, utf8

THRESHOLD = 400
GRAM = 200
SPAN = 25


def runs(raw: np.ndarray, offsets: np.ndarray, size: int = THRESHOLD, gram: int = GRAM):
    """(hasher, first window, last window, gram position) of all runs of a block of texts.

    Windows are within one text. A text longer than 2 ** 30 bytes can't be an Arrow string of Spark.
    """
    hashed = RangeHash(raw)
    width = size - gram + 1
    v = hashed.windows(gram)
    n = len(v)
    none = np.zeros(0, np.int64)
    if n < width:
        return hashed, none, none, none
    bits = np.uint64(max(24, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (v & ~low) | np.arange(n, dtype=np.uint64)
    k = np.concatenate([key, np.full((-n) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(k, 1).ravel()
    behind = np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    sizes = np.diff(offsets)
    valid = np.zeros(len(least) + 1, np.int64)
    long = sizes >= size
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, np.minimum((offsets[1:] - size + 1)[long], len(least)), -1)
    i = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(i):
        return hashed, none, none, none
    p = (least[i] & low).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)
    start = np.flatnonzero(new)
    return hashed, i[start], i[np.append(start[1:], len(i)) - 1], p[start]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


_RUN = "doc_id long, row long, p int, low int, high int, gram long, hull long"


def _runs(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """A row per run: gram position, least and largest distance of its windows' starts before that, digits."""

    def run(batches):
        for b in text_blocks(batches, "text"):
            raw, offsets = utf8(b.column("text"))
            hashed, a, z, p = runs(raw, offsets, size, gram)
            owner = np.searchsorted(offsets, a, side="right") - 1
            take = pa.array(owner)
            hull = _hull(hashed, p, p - z, p - a, size)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("row").take(take), *(pa.array(x.astype(np.int32)) for x in (p - offsets[owner], p - z, p - a)), pa.array(hashed(p, p + gram).view(np.int64)), pa.array(hull)],
                names=["doc_id", "row", "p", "low", "high", "gram", "hull"],
            )

    return docs.where(F.octet_length("text") >= size).mapInArrow(run, _RUN)


def _hull(hashed: RangeHash, p: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Digit of the bytes from the first window's start to the last one's end, and the gram's place in them."""
    with np.errstate(over="ignore"):
        return (hashed(p - high, p - low + size) + high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _cuts(batches, size: int, span: int):
    """Spans of runs with their digits; ``at`` is where the run's gram is in its hull bytes."""
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            b = batch.slice(s, 2048)
            raw, begin, (p, low, high) = _bytes_of(b)
            first, last = low // span, high // span
            count = last - first + 1
            owner = np.repeat(np.arange(len(p)), count)
            k = first[owner] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(k * span, low[owner]), np.minimum(k * span + span - 1, high[owner])
            at = begin[owner] + high[owner]
            hashed = RangeHash(raw)
            with np.errstate(over="ignore"):
                core = (hashed(at - k * span, at - k * span - span + 1 + size) + k.astype(np.uint64)).view(np.int64)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("doc_id", "row", "p")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), b.column("solo").take(take), pa.array(core), pa.array(_hull(hashed, at, lo, hi, size))],
                names=["doc_id", "row", "p", "low", "high", "solo", "core", "hull"],
            )


def _bytes_of(b: pa.RecordBatch):
    data = b.column("bytes").to_pylist()
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in data])])[:-1].astype(np.int64)
    return raw, begin, [np.asarray(b.column(c)).astype(np.int64) for c in ("p", "low", "high")]


def _windows(batches, size: int):
    """Every window of the spans listed for a run."""
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            b = batch.slice(s, 2048)
            raw, begin, (p, _, high) = _bytes_of(b)
            hashed = RangeHash(raw)
            lists = b.column("spans").to_pylist()
            owner = np.repeat(np.arange(len(p)), [sum(x["high"] - x["low"] + 1 for x in one) for one in lists])
            back = np.array([v for one in lists for x in one for v in range(x["low"], x["high"] + 1)], np.int64)
            solo = [x["solo"] for one in lists for x in one for _ in range(x["low"], x["high"] + 1)]
            digit = [x["digit"] for one in lists for x in one for _ in range(x["low"], x["high"] + 1)]
            at = begin[owner] + high[owner] - back if len(owner) else np.zeros(0, np.int64)
            take = pa.array(owner.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("row").take(take), pa.array((p[owner] - back).astype(np.int32) if len(owner) else [], pa.int32()), pa.array(solo, pa.bool_()), pa.array(digit, pa.int64()), pa.array(hashed(at, at + size).view(np.int64) if len(owner) else [], pa.int64())],
                names=["doc_id", "row", "start", "solo", "digit", "window"],
            )


def _cut_out(batches, size: int):
    """The hull bytes of the runs listed for a document."""
    for b in text_blocks(batches, "text"):
        rows = []
        for i, r, t, o in zip(*(b.column(c) for c in ("doc_id", "row", "text", "runs")), strict=True):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            rows += [{"doc_id": i.as_py(), "row": r.as_py(), **x, "bytes": raw[x["p"] - x["high"] : x["p"] - x["low"] + size]} for x in o.as_py()]
        yield pa.RecordBatch.from_pylist(rows, schema=_CUT)


_CUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("p", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("solo", pa.bool_()), ("bytes", pa.binary())])


def _next(rows: DataFrame, digit: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with a digit and a hull: the hulls found twice, and one row per hull of every digit still open.

    A digit is open while it has two or more hulls, one of them found once only.
    """
    place = F.struct(*[c for c in ("doc_id", "row", "p", "low", "high") if c in rows.columns])
    solo = F.max("solo") if "solo" in rows.columns else F.lit(True)
    hulls = rows.groupBy(digit, "hull").agg(F.count("*").alias("n"), solo.alias("solo"), F.min(place).alias("at"))
    hulls = stash(hulls, "hulls")
    open_ = hulls.groupBy(F.col(digit).alias("__digit")).agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("solo")).alias("lone")).where("kinds > 1 AND lone")
    open_ = stash(open_.select("__digit"), "open")
    onward = hulls.join(open_, F.col(digit) == F.col("__digit"), "left_semi").select("at.*", (F.col("solo") & (F.col("n") == 1)).alias("solo"), F.col(digit).alias("digit"))
    return hulls.where("n > 1").select(F.col(digit).alias("__digit"), F.col("hull").alias("__hull")), onward


def repeated(docs: DataFrame, size: int = THRESHOLD, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc_id, row, start, end): byte ranges covered by repeated windows, unordered and overlapping."""
    spark, docs = docs.sparkSession, _keyed(docs)
    every = stash(_runs(docs, size, gram), "runs")
    twice = stash(every.groupBy(F.col("gram").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice"), "grams")
    again = stash(every.join(twice, F.col("gram") == F.col("twice"), "left_semi"), "runs-again")
    release(spark, every, twice)

    def ranges(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "row", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + size).alias("end"))

    found, onward = _next(again, "gram")
    whole = stash(ranges(again.join(found, (F.col("gram") == F.col("__digit")) & (F.col("hull") == F.col("__hull")), "left_semi")), "ranges")
    listed = onward.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("p", "low", "high", "solo")).alias("runs"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    holders = docs.where(F.octet_length("text") >= size).join(listed, same).select("doc_id", "row", "text", "runs")
    hulls = stash(holders.mapInArrow(lambda it: _cut_out(it, size), "doc_id long, row long, p int, low int, high int, solo boolean, bytes binary"), "run-bytes")
    release(spark, again)

    spans = stash(hulls.mapInArrow(lambda it: _cuts(it, size, span), "doc_id long, row long, p int, low int, high int, solo boolean, core long, hull long"), "spans")
    found, onward = _next(spans, "core")
    partly = stash(ranges(spans.where("solo").join(found, (F.col("core") == F.col("__digit")) & (F.col("hull") == F.col("__hull")), "left_semi")), "ranges")
    listed = onward.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("p").alias("__p")).agg(F.collect_list(F.struct("low", "high", "solo", "digit")).alias("spans"))
    held = hulls.join(listed, same & (F.col("p") == F.col("__p"))).select("doc_id", "row", "p", "low", "high", "bytes", "spans")
    windows = stash(held.mapInArrow(lambda it: _windows(it, size), "doc_id long, row long, start int, solo boolean, digit long, window long"), "windows")
    release(spark, spans, hulls)
    twice = windows.groupBy(F.col("digit").alias("group"), F.col("window").alias("twice")).agg(F.count("*").alias("n"), F.max("solo").alias("any")).where("n > 1 AND any")
    twice = stash(twice.select("group", "twice"), "twice")
    single = windows.where("solo").join(twice, (F.col("digit") == F.col("group")) & (F.col("window") == F.col("twice")), "left_semi").select("doc_id", "row", "start", (F.col("start") + size).alias("end"))
    return whole.unionByName(partly).unionByName(single)


def _merge(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, size: int = THRESHOLD, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated(docs, size, gram, span)
    listed = found.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    keyed = _keyed(docs)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    joined = keyed.where(F.octet_length("text") >= size).join(listed, same, "left").select("doc_id", "text", "ranges")

    def run(batches):
        for b in text_blocks(batches, "text"):
            n, removed, spans, digest = [], [], [], []
            for t, r in zip(b.column("text"), b.column("ranges"), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                gone = _merge(r.as_py() or [])
                kept, last = hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(raw[last:a])
                    last = z
                kept.update(raw[last:])
                n.append(len(raw))
                removed.append(sum(z - a for a, z in gone))
                spans.append(len(gone))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], schema=_OUT)

    short = keyed.where(F.octet_length("text") < size).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(short)


def op7(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
