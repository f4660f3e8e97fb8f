"""Near-duplicate documents by Order MinHash and banded alignment.

A document's 5-word shingles are labelled by their occurrence number; each of ``SKETCHES`` hash
functions samples the ``PICK`` smallest labelled shingles and keeps them in text order, so equal
sketches speak for small edit distance. Documents that share a sketch are candidates; a banded
bit-parallel alignment of their words decides: edit similarity 1 - distance / longer length >= 0.8.

The number of sketches follows from the recall asked for at the threshold itself: where one word in
five is another, a third of the shingles stay, 0.2 of all are shared, two that are in order
agree with 0.039, and one of 80 sketches with 0.96 (less for short texts, whose edits vary more).

Equal texts collapse first. Of the members of a bucket of equal sketches each is compared with one
hub, and what then stays in different classes pair by pair, in blocks, behind a bitmap bound
(``common.bucket_links``): no bucket has a cap and none emits all its pairs.

Defined results: null is the empty text; equal texts (empty ones too) are one class; a text of
fewer than five words is one shingle; a text without words has only its equal copies; the smallest
doc_id of a class is its id, null if all are; of a class the document of that id stays (null ids last,
then the smallest text hash), and rows equal in doc_id and text are one document: the query marks all
of them, the pipeline keeps one row; other columns are kept or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import RangeHash, bucket_links, mix64, release, shared_keys, stash, text_blocks, utf8
from gridspark.llm.decontamination import words

SHINGLE = 5
SKETCHES = 80
PICK = 2
SIMILARITY = 0.8

_NORMAL = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_ODD = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, and where each text's words begin (n + 1 numbers)."""
    raw = _NORMAL[raw]
    word = np.append(raw != 32, False)
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    inside = offsets[:-1][offsets[:-1] < len(raw)]
    edge[inside] = word[inside]  # a text's first character begins a word even next to another text's last
    start = np.flatnonzero(edge)
    stop = np.minimum(np.append(start[1:], len(raw)), offsets[np.searchsorted(offsets, start, side="right")] if len(start) else start)
    # the word ends at its first non-word byte
    gaps = np.flatnonzero(~word)
    end = np.minimum(stop, gaps[np.searchsorted(gaps, start)]) if len(start) else start
    return RangeHash(raw)(start, end), np.searchsorted(start, offsets)


def sketch(w: np.ndarray) -> np.ndarray:
    """The order-min-hash sketches of one text's word hashes."""
    n = max(1, len(w) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(min(SHINGLE, len(w))):
            h = mix64(h * np.uint64(3) + w[i : i + n])
        order = np.argsort(h, kind="stable")
        s = h[order]
        label = _labels(s)
        labelled = h.copy()
        again = label > 0
        labelled[order[again]] = mix64(s[again] + label[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k = min(PICK, n)
        out = np.zeros(SKETCHES, np.uint64)
        step = max(1, (1 << 22) // n)
        for a in range(0, SKETCHES, step):
            values = labelled[None] * _ODD[a : a + step, None]
            at = np.empty((len(values), k), np.int64)
            for j in range(k):
                at[:, j] = values.argmin(1)
                if j + 1 < k:
                    values[np.arange(len(values)), at[:, j]] = ~np.uint64(0)
            at.sort(axis=1)
            mixed = np.arange(a, a + len(at), dtype=np.uint64)
            for j in range(k):
                mixed = mix64(mixed * np.uint64(5) + labelled[at[:, j]])
            out[a : a + step] = mixed
    return out


_SKETCHED = "node binary, h long, doc_id long, n_words int, sketches array<long>"
#: 64-bit words of the bitmaps whose differences bound the edit distance from below.
BAG = 64


def _noded(docs: DataFrame) -> DataFrame:
    """(node = md5 of the text, doc_id, text) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """(node, h = its first 64 bits, doc_id, n_words, sketches) for every row; no sketches without words."""

    def run(batches):
        for b in text_blocks(batches, "text"):
            w, first = word_hashes(*utf8(b.column("text")))
            full = np.flatnonzero(np.diff(first))
            flat = np.concatenate([sketch(w[first[k] : first[k + 1]]) for k in full]) if len(full) else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.diff(first) > 0)]).astype(np.int32) * SKETCHES
            h = [int.from_bytes(x[:8], "little", signed=True) for x in b.column("node").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array(h, pa.int64()), b.column("doc_id"), pa.array(np.diff(first), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                names=["node", "h", "doc_id", "n_words", "sketches"],
            )

    return _noded(docs).mapInArrow(run, _SKETCHED)


def sketch_keys(b: pa.RecordBatch):
    """The sketches of every table, for ``shared_keys``."""
    lists = b.column("sketches")
    mine = np.flatnonzero(np.diff(np.asarray(lists.offsets)))
    keys = np.asarray(lists.flatten()).view(np.uint64).reshape(-1, SKETCHES)
    for t in range(SKETCHES if len(mine) else 0):
        yield t, mine, keys[:, t]


def _labels(ordered: np.ndarray) -> np.ndarray:
    """How often each value of a sorted array came before."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(ordered))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def bags(texts: DataFrame) -> DataFrame:
    """(node, text, detail): a bitmap of occurrence-labelled words for every row of (node, text)."""

    def run(batches):
        for b in text_blocks(batches, "text"):
            h, first = word_hashes(*utf8(b.column("text")))
            out = np.zeros((b.num_rows, BAG * 64), np.uint8)
            for k in range(b.num_rows):
                w = np.sort(h[first[k] : first[k + 1]])
                with np.errstate(over="ignore"):
                    labelled = mix64(w + _labels(w).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                out[k, (labelled % np.uint64(BAG * 64)).astype(np.int64)] = 1
            flat = np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BAG), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("text"), lists], names=["node", "text", "detail"])

    return texts.select("node", "text").mapInArrow(run, "node binary, text string, detail array<long>")


def _agree(a: list, i: int, b: list, j: int) -> int:
    """How far two sequences agree from places ``i`` and ``j`` on: doubling steps, then halving."""
    most = min(len(a) - i, len(b) - j)
    if most <= 0 or a[i] != b[j]:
        return 0
    n, step = 1, 8
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
            continue
        while step > 1:  # they differ within this step
            step = (step + 1) // 2
            if a[i + n : i + n + step] == b[j + n : j + n + step]:
                n += step
        return n if n >= most or a[i + n] != b[j + n] else n + _agree(a, i + n, b, j + n)
    return most


#: Edits up to which the distance is found along diagonals, in steps that depend on the edits only.
FEW = 12


def edit_distance(a: list, b: list, most: int) -> int:
    """Levenshtein distance of two sequences, or ``most`` + 1 if it is larger.

    A few edits are found by the furthest place that every diagonal reaches (Ukkonen 1985); for more,
    a bit-parallel band (Hyyro 2003): bit ``j`` of the vectors is the cell ``j`` diagonals above
    the lowest one kept, 2 * most + 1 diagonals in all.
    """
    if len(a) > len(b):
        a, b = b, a
    lead = _agree(a, 0, b, 0)
    tail = 0
    while tail < len(a) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    if m == 0:
        return n
    most = min(most, n)
    reach: dict[int, int] = {}
    for edits in range(min(most, FEW) + 1):
        before, reach = reach, {}
        for k in range(-min(edits, m), min(edits, n) + 1):
            if edits == 0:
                i = 0
            else:
                # a changed element, one that only b has, one that only a has
                i = max(before.get(k, -2) + 1, before.get(k - 1, -2), before.get(k + 1, -2) + 1)
                i = min(i, m, n - k)
                if i < 0 or i + k < 0:
                    continue
            i += _agree(a, i, b, i + k)
            reach[k] = i
            if i >= m and i + k >= n:
                return edits
    if most <= FEW:
        return most + 1
    seen: dict = {}
    for i, x in enumerate(a):
        seen[x] = seen.get(x, 0) | (1 << i)
    # the vectors are a window that slides with the columns of b: window bit k is row j + k - most
    width = 2 * most + 1
    full = (1 << width) - 1
    vp, vn, score = full & ~((1 << (most + 1)) - 1), 0, 0
    diagonal = 1 << most
    for j in range(1, n + 1):
        # slide by one row: bit k now stands for row j + k - most
        vp, vn = (vp >> 1) | (1 << (width - 1)), vn >> 1
        shift = j - most - 1
        mask = seen.get(b[j - 1], 0)
        eq = (mask >> shift if shift >= 0 else mask << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        low = most - j  # window bit of row 0
        if low >= 0:
            # rows at and above 0 are outside: their horizontal difference is +1
            d0 &= ~((1 << (low + 1)) - 1)
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j <= m:
            # along the diagonal
            if not d0 & diagonal:
                score += 1
        else:
            # row m, one column on
            bit = 1 << (m - j + most) if m - j + most >= 0 else 0
            if bit & hp:
                score += 1
            elif bit & hn:
                score -= 1
        if low >= 0:
            hp |= (1 << (low + 1)) - 1
            hn &= ~((1 << (low + 1)) - 1)
        xp = (hp << 1) & full
        xn = (hn << 1) & full
        vp = (xn | ~(d0 | xp)) & full
        vn = d0 & xp
        # values never fall along a diagonal, and change by one at most beside it
        if score > most + n - m:
            return most + 1
    return score if score <= most else most + 1


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return longer > 0 and edit_distance(a, b, most) <= most


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar; ``texts`` holds (node, text) of all nodes in pairs."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches):
        known: dict[bytes, list[bytes]] = {}
        for b in batches:
            keep = []
            for a, z in zip(b.column("a"), b.column("b"), strict=True):
                first, second = words((a.as_py() or "").encode("utf-8", "surrogatepass")), z.as_py() or ""
                if second not in known:
                    known = {second: words(second.encode("utf-8", "surrogatepass"))}  # hubs come in runs
                keep.append(similar(first, known[second], least))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, node (md5 of the text), component, class_id, kept.

    ``class_id`` is the smallest doc_id of the row's class of near copies, ``kept`` says that the row
    is the document that stays of its class.
    """
    spark = docs.sparkSession
    # equal texts are one node from here on
    nodes = stash(sketched(docs).groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("h", "n_words", "sketches")]), "omh-nodes")
    near = shared_keys(nodes.where(F.size("sketches") > 0), sketch_keys, ["sketches"], True, "omh-candidates")
    at = near.join(nodes.select("h", "node", "n_words"), "h").select("bucket", "node", F.col("n_words").alias("size"))
    wanted = nodes.join(near.select("h").distinct(), "h", "left_semi").select("node", F.col("doc_id").alias("of"))
    texts = stash(_noded(docs).join(wanted, "node").where(F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text").dropDuplicates(["node"]), "omh-texts")
    release(spark)
    fits = lambda a, b: F.least(a["size"], b["size"]) >= F.lit(similarity) * F.greatest(a["size"], b["size"]) - 1e-9

    def close(data, i, j):
        """What one text has and the other lacks is a lower bound of the distance: it rules pairs out."""
        size, bag = data["size"], data["detail"].view(np.uint64)
        if "folded" not in data:  # an eighth of the bits bounds the distance too, at an eighth of the work
            data["folded"] = np.bitwise_or.reduce(bag.reshape(len(bag), BAG // 8, 8), axis=1)
        longer = np.maximum(size[j], size[i])
        most = np.floor((1 - similarity) * longer + 1e-9)
        out = longer - np.minimum(size[j], size[i]) <= most
        for bits in (data["folded"], bag):
            left = np.flatnonzero(out)
            for s in range(0, len(left), 1 << 14):
                at = left[s : s + (1 << 14)]
                one, two = bits[i[at]], bits[j[at]]
                lacks = [np.bitwise_count(x).sum(1) for x in (one & ~two, two & ~one)]
                out[at] = np.maximum(*lacks) <= most[at]
        return out

    def decide(data, i, j):
        known = data.setdefault("words", {})
        for k in (i, j):
            if k not in known:
                known[k] = words(data["text"][k].as_py().encode("utf-8", "surrogatepass"))
        return similar(known[i], known[j], similarity)

    label = bucket_links(at, fits, lambda pairs: _verified(pairs, texts, similarity), close, decide, "omh", bags(texts))
    joined = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = joined.groupBy("component").agg(F.min(place).alias("best")).select("component", F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("first"))
    named = stash(joined.select("node", "component").join(best, "component"), "omh-named")
    release(spark, nodes, near, texts, label)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first"))
    return _noded(docs).select("node", "doc_id").join(named, "node").select("doc_id", "node", "component", "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near copies, all columns kept.

    Of repeated rows that one stays whose columns, as JSON, have the least hash.
    """
    kept = classes(docs, similarity).where("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    kept = stash(kept.groupBy("__id", "__node").agg((F.count("*") > 1).alias("__again")), "omh-kept")
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (node == F.col("__node"))
    joined = docs.join(kept, same)
    if not kept.where("__again").limit(1).count():
        return joined.select(*docs.columns)
    whole = F.struct(*docs.columns)
    once = joined.where("__again").groupBy("__id", "__node").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row"))
    return joined.where("NOT __again").select(*docs.columns).unionByName(once.select("__row.*"))


def op10(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
