"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has features of its own and of the lines before and after it; forward-backward gives
the marginal probability that a line is good, and a document's quality is the marginals' mean
weighted by line length, put on the probability scale by a logistic calibration. Scores cover every
whole text.

Labels are of documents, those of lines are latent. The field is fitted in turns: at first every line takes
its document's label; then the marginals of the fit so far relabel lines, so that a bad document's lines are good
where they look good (never all of them) and a good document's are bad where they clearly look bad
(never most of it by length). Moves are learned from the second turn on, when lines of both kinds
follow each other. The sample is bounded:
at most ``TRAIN_DOCS`` labelled documents, by seeded hash, and ``TRAIN_LINES`` lines of each. One in
``HELD`` of them is not fitted but calibrates the score.

Defined results: a null or empty text scores 0.0; repeated rows give repeated results, and of rows that
share a labelled doc_id one teaches; a null doc_id counts as the empty text for ``held_out`` and teaches
nothing; labels that are null or whose document is missing teach nothing; without any usable label of both
kinds every text scores 0.5, empty ones 0; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import RangeHash, text_blocks, utf8

#: Labelled documents that the field is fitted on at most (the first by seeded hash), and lines of each.
TRAIN_DOCS, TRAIN_LINES = 3000, 2000
#: One in so many sampled documents calibrates, and turns of relabelling lines.
HELD, TURNS = 4, 2
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.int64)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b".,;:'\"-()?", b"!", b"|", b"#$%&*@^~+=<>[]{}\\/_`", bytes(range(128, 192)), bytes(range(192, 256))], 1):
    _KINDS[list(_chars)] = _k
_N = 11
_WORD = np.ones(256, bool)
_WORD[list(b" \t\r\v\f\n")] = False
N_FEATURES = _N + 7


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, byte lengths, first line of each text + end) of the non-blank lines of a block of texts."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    # a text's first line starts with it; sort puts every start and every end in order
    starts, ends = np.sort(starts), np.sort(ends)
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    length = ends - starts
    line_of = np.repeat(np.arange(len(starts)), length)
    where = np.arange(int(length.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(starts) else np.zeros(0, np.int64)
    body = raw[where]
    counts = np.bincount(line_of * _N + _KINDS[body], minlength=len(starts) * _N).reshape(-1, _N).astype(float)
    share = counts / np.maximum(length, 1)[:, None]
    # words: starts and ends inside the line
    word = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = word[1:] & ~word[:-1]
        edge[0] = word[0]
        edge[offsets[:-1]] |= np.append(word, False)[offsets[:-1]]
    w_start = np.flatnonzero(edge[: len(raw)])
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:-1] = word[:-1] & ~word[1:]
    if len(word):
        stop[-1] = word[-1]
    stop[offsets[1:]] |= np.append(False, word)[offsets[1:]]
    w_end = np.flatnonzero(stop)
    owner = np.searchsorted(starts, w_start, side="right") - 1
    n_words = np.bincount(owner, minlength=len(starts)).astype(float) if len(starts) else np.zeros(0)
    h = RangeHash(raw)(w_start, w_end)
    order = np.lexsort((h, owner))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(starts)).astype(float) if len(starts) else np.zeros(0)
    same = np.zeros(len(w_start), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    twins = np.bincount(owner[same], minlength=len(starts)).astype(float) if len(starts) else np.zeros(0)
    lone = np.bincount(owner[(w_end - w_start) == 1], minlength=len(starts)).astype(float) if len(starts) else np.zeros(0)
    per = np.maximum(n_words, 1)
    more = np.stack([np.log1p(length) / 6, np.log1p(n_words) / 4, (length / per) / 20, distinct / per, twins / per, lone / per, (ends > starts) * 1.0], 1)
    first = np.searchsorted(starts, offsets)
    first[n_docs] = len(starts)
    return np.concatenate([share, more], 1), length, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every line's features, those of the line before and of the line after (zero at a text's ends)."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    begin, end = first[:-1], first[1:]
    full = end > begin
    before[begin[full]] = 0
    after[end[full] - 1] = 0
    return np.concatenate([f, before, after], 1)


def forward_backward(emit: np.ndarray, move: np.ndarray, first: np.ndarray):
    """Log partition of every text, line marginals and expected moves of a two-state chain."""
    begin, size = first[:-1], np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]  # texts with more than t lines
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(longest):
        at = begin[: live[t]] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            alpha[at] = np.logaddexp(alpha[at - 1, :1] + move[0], alpha[at - 1, 1:] + move[1]) + emit[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
    full = np.diff(first) > 0
    z = np.zeros(len(first) - 1)
    last = first[1:][full] - 1
    z[full] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    line_z = np.repeat(z, np.diff(first))
    marginal = np.exp(alpha + beta - line_z[:, None])
    inner = np.ones(len(emit), bool)
    inner[first[:-1][full]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + move[None] + (emit[at] + beta[at])[:, None, :] - line_z[at][:, None, None])
    return z, marginal, pair


class Field:
    """A fitted two-state chain with its feature scaling and document calibration."""

    def __init__(self, n: int):
        self.mean, self.std = np.zeros(n), np.ones(n)
        self.w, self.b, self.move = np.zeros(n), 0.0, np.zeros((2, 2))
        self.scale, self.shift = 0.0, 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.std) @ self.w + self.b
        return np.stack([-s / 2, s / 2], 1)

    def raw_scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; nan for texts without lines."""
        _, marginal, _ = forward_backward(self.emissions(x), self.move, first)
        sums = np.concatenate([[0], np.cumsum(marginal[:, 1] * length)]), np.concatenate([[0], np.cumsum(length)])
        good, all_ = (np.diff(s[first]) for s in sums)
        return np.where(all_ > 0, good / np.maximum(all_, 1), np.nan)

    def scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        m = np.clip(self.raw_scores(x, length, first), 1e-6, 1 - 1e-6)
        p = 1 / (1 + np.exp(-(self.scale * np.log(m / (1 - m)) + self.shift)))
        return np.where(np.isnan(p), 0.0, p)

    def fit(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 80, turns: int = TURNS) -> Field:
        if not (0 < y.sum() < len(y)):
            return self
        apart = np.arange(len(y)) % HELD == HELD - 1
        if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
            apart[:] = False  # too few to leave any out
        own, held = (_subset(x, length, first, y, pick) for pick in (~apart, apart if apart.any() else ~apart))
        self.mean, self.std = own[0].mean(0), np.maximum(own[0].std(0), 1e-6)
        lines = np.repeat(own[3], np.diff(own[2])).astype(int)
        for turn in range(turns + 1):
            self._descend(*own[:3], lines, rounds, turn > 0)
            if turn < turns:
                lines = self.relabelled(*own)
        self._calibrate(*held)
        return self

    def relabelled(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Labels of lines by their marginals, as far as the documents' labels allow."""
        marginal = forward_backward(self.emissions(x), self.move, first)[1][:, 1]
        lines = np.repeat(y, np.diff(first)).astype(int)
        for k in range(len(y)):
            own = slice(first[k], first[k + 1])
            m = marginal[own]
            if not len(m):
                continue
            if y[k] < 0.5:
                label = m > 0.5
                label[m.argmin()] = False
            else:
                label = m > 0.1
                if (label * length[own]).sum() < 0.5 * length[own].sum():
                    label[:] = True
            lines[own] = label
        return lines

    def _descend(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, lines: np.ndarray, rounds: int, moves: bool, rate: float = 0.1) -> None:
        """Gradient steps (Adam) on the likelihood of the lines' labels; moves stay as they are unless ``moves``."""
        x_ = (x - self.mean) / self.std
        # each text weighs the same, however many lines it has
        weight = np.repeat(1 / np.maximum(np.diff(first), 1), np.diff(first))
        full = np.diff(first) > 0
        inner = np.ones(len(x), bool)
        inner[first[:-1][full]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (lines[at - 1], lines[at]), weight[at])
        m, s = np.zeros(len(self.w) + 5), np.zeros(len(self.w) + 5)
        n = len(first) - 1
        for t in range(1, rounds + 1):
            score = x_ @ self.w + self.b
            _, marginal, pair = forward_backward(np.stack([-score / 2, score / 2], 1), self.move, first)
            error = weight * (marginal[:, 1] - lines)
            g = np.concatenate([x_.T @ error / n + 1e-3 * self.w, [error.sum() / n], (((pair * weight[at][:, None, None]).sum(0) - seen) / n + 1e-2 * self.move).ravel()])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - step[: len(self.w)], self.b - step[len(self.w)]
            if moves:
                self.move = self.move - step[-4:].reshape(2, 2)

    def _calibrate(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        raw = np.clip(self.raw_scores(x, length, first), 1e-6, 1 - 1e-6)
        ok = ~np.isnan(raw)
        feature, truth = np.log(raw[ok] / (1 - raw[ok])), y[ok]
        a, b = 0.3, 0.0
        for _ in range(60):  # Newton's method on the two calibration parameters
            p = 1 / (1 + np.exp(-(a * feature + b)))
            r, v = p - truth, p * (1 - p) + 1e-9
            h = np.array([[(v * feature * feature).sum() + 1e-3, (v * feature).sum()], [(v * feature).sum(), v.sum() + 1e-3]])
            d = np.linalg.solve(h, [(r * feature).sum() + 1e-3 * a, r.sum()])
            a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
        self.scale, self.shift = max(float(a), 0.01), float(b)


def _subset(x: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray, pick: np.ndarray) -> tuple:
    """The texts picked: features, lengths, first lines, labels."""
    rows = np.repeat(pick, np.diff(first))
    return x[rows], length[rows], np.concatenate([[0], np.cumsum(np.diff(first)[pick])]), y[pick]


def held_out_column():
    """crc32 of doc_id as text, modulo 4, is 2."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 3) -> Field:
    """The field from at most ``train_docs`` labelled, not held-out rows; the sample's lines reach the driver as features."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column())
    sample = usable.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("y")).orderBy(F.xxhash64("of", F.lit(seed)), "of").limit(train_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("doc_id", "text", F.col("y").cast("int").alias("y"))

    def lines(batches):
        for b in text_blocks(batches, "text"):
            f, length, first = line_features(*utf8(b.column("text")))
            ends = np.minimum(first[1:], first[:-1] + TRAIN_LINES)
            rows = [f[a:z].astype(np.float32).tobytes() for a, z in zip(first[:-1], ends, strict=True)]
            sizes = [length[a:z].astype(np.int64).tobytes() for a, z in zip(first[:-1], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "y", "f", "length"])

    taught = texts.mapInArrow(lines, "doc_id long, y int, f binary, length binary").groupBy("doc_id", "y").agg(F.min(F.struct("length", "f")).alias("l"))
    got = taught.select("doc_id", "y", "l.*").orderBy("doc_id").collect()  # at most ``train_docs`` rows of ``TRAIN_LINES`` lines
    field = Field(3 * N_FEATURES)
    if not got:
        return field
    parts = [np.frombuffer(r["f"], np.float32).reshape(-1, N_FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    f = np.concatenate(parts).astype(float)
    length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in got])
    return field.fit(with_neighbours(f, first), length, first, np.array([r["y"] for r in got], float))


def _score_block(b: pa.RecordBatch, field: Field) -> np.ndarray:
    f, length, first = line_features(*utf8(b.column("text")))
    return field.scores(with_neighbours(f, first), length, first)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in text_blocks(batches, "text"):
            ids = b.column("doc_id").to_pylist()
            s = _score_block(b, field)
            held = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array(s >= THRESHOLD, pa.int32())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept; one map, no shuffle."""

    def run(batches):
        for b in text_blocks(batches, "text"):
            yield b.filter(pa.array(_score_block(b, field) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
