"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated by seeded random orthogonal matrices and reduced to the signs of its
coordinates. The written table of codes holds, for each different vector: the packed signs, a correction
factor <code, vector> for every rotation, and the vector itself rounded at random to 4 bits a
coordinate, so that it is right on average. For a pair, <code, rounded other> / factor is an unbiased
estimate of the inner product with a known error bound, one for every rotation and from either side.

Codes, an eighth of the vectors or so, travel to where candidates meet; the vectors only follow to tasks
where the upper confidence bound of a pair reaches the threshold, and what is linked is decided there by
the cosine in double precision. Candidates share a run of signs in one of several tables; the number of signs
grows with the logarithm of the number of vectors, without end, and the number of tables with the
recall asked for at the threshold. Groups of candidates are compared in blocks, so no task holds more than
two blocks of a group, pairs are never emitted, and a pair that shares several tables counts in the first one only.

Defined results: a vector is a node of its own key (128 bits of hash over its bytes), whatever its vec_id;
rows with equal vectors link with each other; a vec_id that repeats or is null gives a row each, with
the links of that row's own vector. Vectors that are null, empty, zero, or hold null or non-finite
components have no links and are classes of their own; vectors of different lengths never link.
component_id is the smallest vec_id that is not null; where all are null it is null and kept is true. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import components, release, stash

THRESHOLD = 0.9
RECALL = 0.995
#: Vectors of one group that a task compares with those of one other block of it.
BLOCK = 1024
#: Standard deviations of the estimate that a pair may fall short by and still be recomputed.
CONFIDENCE = 4.0
SEED = 17


@functools.lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a table, tables): groups of unrelated vectors stay small, recall holds at the threshold itself."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) - 7)
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codes:
    """Signs (n x rotations * dim), factors (n x rotations) and rounded vectors (n x dim) of unit vectors."""

    def __init__(self, signs: np.ndarray, factors: np.ndarray, rounded: np.ndarray, seed: int):
        self.signs, self.factors, self.rounded, self.seed = signs, factors, rounded, seed

    @classmethod
    def of(cls, x: np.ndarray, rotations: int, seed: int) -> Codes:
        dim = x.shape[1]
        turned = np.concatenate([x @ rotation(dim, seed + k) for k in range(rotations)], 1)
        factors = np.abs(turned).reshape(len(x), rotations, dim).sum(2) / math.sqrt(dim)
        # 4 bits a coordinate of the first rotation, up or down with the chance that makes the mean right
        first, span = turned[:, :dim], np.abs(turned[:, :dim]).max(1)[:, None] / 7.5
        chance = np.random.default_rng(seed + dim).random(dim)
        levels = np.clip(np.floor(first / span + 7.5 + chance), 0, 15)
        return cls(turned > 0, factors, ((levels - 7.5) * span).astype(np.float32), seed)

    def pack(self) -> list[np.ndarray]:
        """Bytes of a row each: signs, factors, 4-bit levels with their scale."""
        span = np.abs(self.rounded).max(1) / 7.5
        span = np.where(span > 0, span, 1).astype(np.float32)
        levels = np.rint(self.rounded / span[:, None] + 7.5).astype(np.uint8)
        levels = np.concatenate([levels, np.zeros((len(levels), levels.shape[1] % 2), np.uint8)], 1)
        packed = levels[:, ::2] | (levels[:, 1::2] << 4)
        return [np.packbits(self.signs, axis=1), np.ascontiguousarray(self.factors.astype(np.float32)).view(np.uint8), np.concatenate([packed, span[:, None].view(np.uint8)], 1)]

    @classmethod
    def unpack(cls, rows: list[bytes], dim: int, rotations: int, seed: int) -> Codes:
        flat = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        n_signs, n_factors = -(-rotations * dim // 8), 4 * rotations
        signs = np.unpackbits(flat[:, :n_signs], axis=1)[:, : rotations * dim].astype(bool)
        factors = np.ascontiguousarray(flat[:, n_signs : n_signs + n_factors]).view(np.float32)
        rest = flat[:, n_signs + n_factors :]
        span = np.ascontiguousarray(rest[:, -4:]).view(np.float32)
        levels = np.stack([rest[:, :-4] & 15, rest[:, :-4] >> 4], 2).reshape(len(rows), -1)[:, :dim]
        return cls(signs, factors, (levels.astype(np.float32) - 7.5) * span, seed)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.signs[rows], self.factors[rows], self.rounded[rows], self.seed)

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products with ``other``, by own codes, and their standard errors for unit vectors.

        One rotation's error is sqrt((1 - f * f) / (f * f * (dim - 1))), that of the rounding is a quarter of a level
        for each coordinate on average; rotations are independent and their estimates are averaged.
        """
        dim, rotations = self.rounded.shape[1], self.factors.shape[1]
        back = other.rounded.astype(np.float64) @ rotation(dim, self.seed).T
        total = np.zeros((len(self.signs), len(other.signs)), np.float32)
        for k in range(rotations):
            code = np.where(self.signs[:, k * dim : (k + 1) * dim], 1, -1).astype(np.float32) / math.sqrt(dim) / self.factors[:, k : k + 1].astype(np.float32)
            total += code @ (back @ rotation(dim, self.seed + k)).astype(np.float32).T
        f2 = self.factors.astype(np.float64) ** 2
        error = np.sqrt(((1 - f2) / f2).sum(1) / max(dim - 1, 1)) / rotations
        level = np.abs(other.rounded).max(1) / 7.5
        return total / rotations, error[:, None] + level[None] / 2 / np.sqrt(f2.min(1))[:, None]

    def possible(self, other: Codes, threshold: float) -> np.ndarray:
        """Pairs whose upper confidence bound reaches the threshold, from both sides."""
        estimate, error = self.estimates(other)
        swapped, error2 = other.estimates(self)
        return (estimate + CONFIDENCE * error >= threshold) & (swapped + CONFIDENCE * error2 >= threshold).T

    def keys(self, bits: int, tables: int) -> np.ndarray:
        """Each table's key: the next ``bits`` signs."""
        return self.signs[:, : bits * tables].reshape(len(self.signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors have a cosine of at least the threshold (len(a) x len(b)), in double precision."""
    out = a @ b.T
    near = np.abs(out - threshold) < 1e-9
    out = out >= threshold
    i, j = np.nonzero(near)
    out[i, j] = (a[i] * b[j]).sum(1) >= threshold
    return out


def union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of linked nodes in place: afterwards ``root`` holds every node's smallest node."""
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (upper := root[root]).tolist() != root.tolist():
            root[:] = upper


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, vector) of every row: bytes of the vector and 128 bits of their hash, null where it links with nothing."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    dtype = np.float32 if kind == "float" else np.float64

    def run(batches):
        for b in batches:
            lists = b.column("embedding")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten()
            ends = np.concatenate([[0], np.cumsum(size)])
            value = np.asarray(pc.fill_null(flat, float("nan"))).astype(dtype)
            bad, some = (np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) > 0 for x in (~np.isfinite(value), value != 0))
            good = ~bad & some
            rows = [value[ends[k] : ends[k + 1]].tobytes() if good[k] else None for k in range(b.num_rows)]
            node = [x and hashlib.blake2b(x, digest_size=16).digest() for x in rows]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(node, pa.binary()), pa.array(rows, pa.binary())], names=["vec_id", "node", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, node binary, vector binary"), dtype


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    mapped, dtype = _vectors(vectors)
    rows = stash(mapped, "vectors")
    width = np.dtype(dtype).itemsize
    nodes = stash(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vector-nodes")
    bits, tables = plan(nodes.count(), threshold, recall)

    def code(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                raw = part.column("vector").to_pylist()
                sizes = np.array([len(x) for x in raw])
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    dim = size // width
                    codes = Codes.of(unit(np.frombuffer(b"".join(raw[k] for k in at), dtype).reshape(-1, dim)), -(-bits * tables // dim), seed)
                    packed = np.concatenate(codes.pack(), 1)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node").take(take), part.column("copies").take(take), pa.array(np.full(len(at), dim, np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(list(codes.keys(bits, tables)), pa.list_(pa.int64()))],
                        names=["node", "copies", "dim", "code", "keys"],
                    )

    coded = stash(nodes.select("node", "copies", "vector").mapInArrow(code, "node binary, copies long, dim int, code binary, keys array<long>"), "codes")
    at = coded.select("node", "dim", F.posexplode("keys").alias("t", "key")).select("node", "t", F.xxhash64("t", "key", "dim").alias("bucket"))
    groups = stash(at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")), "code-groups")
    mine = at.join(groups, "bucket").withColumn("p", F.pmod(F.xxhash64("node", "t"), F.col("parts")).cast("int"))
    # block pairs (low, high) of a group: a vector goes to each pair that its block is in
    spread = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = spread.select("node", "t", "bucket", F.least("p", "o").alias("low"), F.greatest("p", "o").alias("high"), "p")
    task = ["bucket", "t", "low", "high"]

    def blocks(table: pa.Table) -> tuple:
        """Rows of the two blocks of a task, and their columns."""
        low, high, p = (np.asarray(table.column(c)) for c in ("low", "high", "p"))
        return np.flatnonzero(p == low), np.flatnonzero(p == high), low[0] == high[0], table.column("t")[0].as_py()

    def codes_of(table: pa.Table) -> Codes:
        dim = table.column("dim")[0].as_py()
        return Codes.unpack(table.column("code").to_pylist(), dim, -(-bits * tables // dim), seed)

    def screen(table: pa.Table) -> pa.Table:
        """The rows of a task that may have a link in it."""
        one, two, same, _ = blocks(table)
        codes = codes_of(table)
        live, right = np.zeros(table.num_rows, bool), codes.take(two)
        for s in range(0, len(one), 256):
            a = one[s : s + 256]
            hit = codes.take(a).possible(right, threshold)
            if same:
                hit[a[:, None] == two[None]] = False
            live[a] |= hit.any(1)
            live[two] |= hit.any(0)
        return table.select(["node", *task, "p"]).filter(pa.array(live))

    full = tasks.join(coded.select("node", "dim", "code"), "node")
    kind = "node binary, bucket long, t int, low int, high int, p int"
    live = stash(full.groupBy(*task).applyInArrow(screen, kind), "code-survivors")

    def compare(table: pa.Table) -> pa.Table:
        one, two, same, t = blocks(table)
        node = table.column("node").to_pylist()
        copies = np.asarray(table.column("copies"))
        x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype).reshape(len(node), -1))
        keys = codes_of(table).keys(bits, t) if t else np.zeros((len(node), 0), np.int64)
        order = np.argsort(np.array(node, "S16"), kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        degree, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for s in range(0, len(one), 512):
            a = one[s : s + 512]
            hit = linked(x[a], x[two], threshold)
            if same:
                hit[a[:, None] == two[None]] = False
            i, j = np.nonzero(hit)
            for c in range(0, len(i), 1 << 16):  # what met in an earlier table counted there
                part = slice(c, c + (1 << 16))
                hit[i[part], j[part]] &= ~(keys[a[i[part]]] == keys[two[j[part]]]).any(1)
            degree[a] += hit @ copies[two]
            if not same:
                degree[two] += copies[a] @ hit
            i, j = np.nonzero(hit)
            union(root, rank[a[i]], rank[two[j]])
        least = [node[order[r]] for r in root[rank].tolist()]
        return pa.table({"node": pa.array(node, pa.binary()), "degree": degree, "least": pa.array(least, pa.binary())}).filter(pa.array(degree > 0))

    exact = live.join(nodes.select("node", "copies", "vector"), "node").join(coded.select("node", "dim", "code"), "node")
    found = stash(exact.groupBy(*task).applyInArrow(compare, "node binary, degree long, least binary"), "links")
    release(spark, live, groups, coded)
    degree = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    label = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")), "vectors")
    classed = nodes.select("node", "least", "copies").join(degree, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stash(classed.join(best, "component").select("node", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-classes")
    joined = rows.where("node IS NOT NULL").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT r FROM (SELECT r, unnest(e) AS x FROM v) GROUP BY r HAVING count(x) = count(*) AND bool_and(isfinite(x)) AND bool_or(x <> 0)),
ok AS (SELECT * FROM v WHERE r IN (SELECT r FROM fine)),
l AS (SELECT a.r AS u, b.r AS w FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(u, w) AS (SELECT r, r FROM v UNION SELECT reach.u, l.w FROM reach JOIN l ON reach.w = l.u),
named AS (SELECT u, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.w GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN named ON v.r = named.u LEFT JOIN degree ON v.r = degree.u
"""
