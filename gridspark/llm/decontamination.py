"""Benchmark decontamination: Wu-Manber search of 8-word windows over normalised texts.

Texts are lower-cased (A-Z), words are runs of digits, letters and non-ASCII characters, and words
are joined by one space, so a window is one byte string between spaces. A shift table over blocks
of B bytes lets the search skip positions where no window can end; at shift 0 a bucket keyed by the
block selects windows, which are then compared byte by byte. Many lanes of a text are searched in
step, so the scan stays vectorised.

Defined results: a null text has no words; an item without words never occurs; a repeated item
counts once per distinct ``item_id``; items without an id are one item, listed as the empty string; an
empty benchmark hits nothing; rows of documents that repeat give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import BLOCK_BYTES, mix64, stash, text_blocks, utf8

WINDOW = 8
#: Benchmark rows and bytes of their texts that one pass over the documents searches for, about; more are more passes.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 32 << 20
TABLE_BITS = 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WuManber:
    """Finds all occurrences of byte patterns; patterns of similar length share a shift table."""

    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in set(patterns):
            classes[min(len(p).bit_length(), 6)].append(p)
        self.tables = [self._table(group) for group in classes.values()]

    @staticmethod
    def _key(blocks: np.ndarray) -> np.ndarray:
        return (mix64(blocks) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _table(self, patterns: list[bytes]) -> tuple:
        least = min(map(len, patterns))
        block = min(8, max(2, least // 2))
        shift = np.full(1 << TABLE_BITS, least - block + 1, np.uint8 if least < 250 else np.int32)
        buckets: dict[int, list[bytes]] = defaultdict(list)
        heads = np.frombuffer(b"".join(p[:least] for p in patterns), np.uint8).reshape(-1, least)
        for end in range(block, least + 1):
            values = self._blocks(heads[:, end - block : end])
            np.minimum.at(shift, self._key(values), least - end)
        for p, value in zip(patterns, values.tolist(), strict=True):
            buckets[value].append(p)
        return least, block, shift, dict(buckets), np.sort(np.array(list(buckets), np.uint64))

    @staticmethod
    def _blocks(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for i in range(rows.shape[1]):
            out = (out << np.uint64(8)) | rows[:, i]
        return out

    def search(self, text: bytes, lane: int = 256) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence in ``text``."""
        raw = np.frombuffer(text, np.uint8)
        for least, block, shift, buckets, keys in self.tables:
            if len(raw) < least:
                continue
            # value of the block that ends at each position, big-endian
            n = len(raw) - block + 1
            blocks = np.zeros(n, np.uint64)
            for i in range(block):
                blocks = (blocks << np.uint64(8)) | raw[i : i + n]
            steps = shift[self._key(blocks)]
            at = np.arange(least - block, n, lane)
            stop = np.minimum(at + lane, n)
            while len(at):
                here = steps[at]
                found = at[here == 0]
                if len(found):
                    value = blocks[found]
                    place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                    sure = keys[place] == value
                    for p, v in zip(found[sure].tolist(), value[sure].tolist(), strict=True):
                        start = p + block - least
                        for pattern in buckets[v]:
                            if text.startswith(pattern, start):
                                yield start, pattern
                at = at + np.maximum(here, 1)
                live = at < stop
                at, stop = at[live], stop[live]


def windows_of(items: list[tuple], size: int = WINDOW) -> dict[bytes, list[int]]:
    """Pattern -> positions in ``items`` of those that hold it; a pattern is the window between spaces."""
    out: dict[bytes, set[int]] = defaultdict(set)
    for k, text in enumerate(items):
        w = words((text or "").encode("utf-8", "surrogatepass"))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out[b" " + b" ".join(w[i : i + size]) + b" "].add(k)
    return {p: sorted(k) for p, k in out.items()}


_HITS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
HITS = "doc_id long, row long, n_words long, starts array<int>, ends array<int>, items array<string>"
DIGEST = "doc_id long, row long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, full boolean"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("full", pa.bool_())])


class Scanner:
    """The hits of one set of items in batches of texts."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.ids = [i for i, _ in items]
        self.owners = windows_of([t for _, t in items], size)
        self.engine = WuManber(list(self.owners)) if self.owners else None

    def hits(self, b: pa.RecordBatch) -> tuple[list, list, list, list]:
        """Per text: number of words, starts and ends of the hit word ranges, ids (None without hits)."""
        data, offsets = utf8(b.column("text"))
        data = data.tobytes().translate(_TABLE)
        n_words, parts, begins, total = [], [], [], 0
        for i in range(b.num_rows):
            w = data[offsets[i] : offsets[i + 1]].split()
            n_words.append(len(w))
            part = b" " + b" ".join(w) + b" \n" if w else b"\n"
            begins.append(total)
            total += len(part)
            parts.append(part)
        found: dict[int, set] = defaultdict(set)
        if self.engine:
            begin = np.array(begins)
            for start, pattern in self.engine.search(b"".join(parts)):
                found[int(np.searchsorted(begin, start, side="right")) - 1].add((start, pattern))
        starts, ends, ids = ([None] * b.num_rows for _ in range(3))
        for i, hits in found.items():
            spaces = np.flatnonzero(np.frombuffer(parts[i], np.uint8) == 32)
            first = np.searchsorted(spaces, np.array([h[0] for h in hits]) - begins[i])
            starts[i] = first.tolist()
            ends[i] = (first + np.array([h[1].count(b" ") - 1 for h in hits])).tolist()
            ids[i] = sorted({self.ids[k] for h in hits for k in self.owners[h[1]]})
        return n_words, starts, ends, ids


def _digest(starts: list | None, ends: list | None, ids: list | None, size: int) -> tuple[int, int, str, bool, bool]:
    total, reach, names = 0, -1, sorted(set(ids or ()))
    for a, z in sorted(zip(starts or (), ends or (), strict=True)):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    full = any(z - a == size for a, z in zip(starts or (), ends or (), strict=True))
    return total, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2, full


def _digests(b: pa.RecordBatch, size: int, n_words, starts, ends, ids) -> pa.RecordBatch:
    digest = list(zip(*(_digest(*hit, size) for hit in zip(starts, ends, ids, strict=True)), strict=True)) or [[], [], [], [], []]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n_words, pa.int64()), *(pa.array(x, t) for x, t in zip(digest, _DIGEST.types[3:], strict=True))], schema=_DIGEST)


def _passes(benchmark: DataFrame, items_a_pass: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of about ``items_a_pass`` rows and ``BYTES_A_PASS`` bytes; only one part is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-rows // items_a_pass), -(-size // BYTES_A_PASS))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield passes, sorted(((r[0], r[1] or "") for r in part.collect()))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated, full.

    ``full`` says that an occurrence has ``size`` words, not only that the hits have as many together.
    ``row`` is xxhash64 of the text and tells apart rows that share a doc_id. The benchmark is
    searched in passes of ``items_a_pass`` items: one pass (the usual case) is a single map over the
    documents without a shuffle; with more, each pass's hits are written and merged per document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    outs = []
    for passes, items in _passes(benchmark, items_a_pass):

        def scan(batches, items=items, whole=passes == 1):
            scanner = Scanner(items, size)
            for b in text_blocks(batches, "text", BLOCK_BYTES):
                hits = scanner.hits(b)
                yield _digests(b, size, *hits) if whole else pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *(pa.array(x, t) for x, t in zip(hits, _HITS.types[2:], strict=True))], schema=_HITS)

        if passes == 1:
            return rows.mapInArrow(scan, DIGEST)
        outs.append(stash(rows.mapInArrow(scan, HITS), "decontaminate"))
    found = outs[0].where("items IS NOT NULL")
    for x in outs[1:]:
        found = found.unionByName(x.where("items IS NOT NULL"))
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])
    merged = outs[0].select("doc_id", "row", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left")

    def digest(batches):
        for b in batches:
            yield _digests(b, size, *(b.column(c).to_pylist() for c in ("n_words", "starts", "ends", "items")))

    return merged.select("doc_id", "row", "n_words", "starts", "ends", "items").mapInArrow(digest, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, all columns kept.

    A row goes when it is contaminated (two items or more) or when a full window of ``size`` words
    of any item is in it; an item shorter than a window alone, which may be any phrase, isn't enough.
    """
    hits = contamination(docs, benchmark, size, items_a_pass)
    dirty = hits.where(F.col("contaminated") | F.col("full")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(dirty, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left_anti")


def op6(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("row", "full")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM x)),
h AS (SELECT r, item, i, n FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) JOIN x USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
