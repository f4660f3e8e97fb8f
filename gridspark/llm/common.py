"""Helpers shared by the corpus operators: scratch tables, byte views of text columns, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel looks at; a single longer text is taken alone.
BLOCK_BYTES = 2 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share.

    ``spark.checkpoint.dir`` of the session; only where that is unset (tests, one machine) a
    temporary folder is made and remembered in the session.
    """
    for key in ("spark.checkpoint.dir", "spark.gridspark.scratch"):
        if root := spark.conf.get(key, None):
            return root.rstrip("/")
    root = "file://" + tempfile.mkdtemp(prefix="gridspark-")
    spark.conf.set("spark.gridspark.scratch", root)
    return root


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stashed table that no pending plan reads any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if root.split("://")[-1].lstrip("/") in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *used: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more, and let Spark drop the shuffles that nothing refers to.

    Shuffle files go when the driver's collectors find that no plan refers to them; without a
    call they stay until the heap fills up, which on a driver with little to do is never.
    """
    for df in used:
        drop_stash(df)
    gc.collect()
    spark._jvm.System.gc()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, at, data = col.buffers()
    if len(col) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes of text each, so that kernels use bounded memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


_WEYL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + _WEYL).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D
#: Another base: hashes of 128 bits take both.
SECOND_BASE = 0x9FB21C651E98DF25
_VALUES = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(77))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            got[1:] = np.uint64(base)
            np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer from a single prefix sum."""

    def __init__(self, raw: np.ndarray, base: int = _BASE):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUES[raw] * powers(len(raw), base), out=self.sums[1:])
        self.back = powers(len(raw) + 1, pow(base, -1, 1 << 64))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.back[start]
            return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of every window of ``size`` bytes; the same values as calling with their ranges."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = (self.sums[size:] - self.sums[:n]) * self.back[:n]
            return mix64(h + np.uint64(size) * np.uint64(0xD6E8FEB86659FD93))


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, component = its smallest node).

    Each round gives every node its smallest neighbour as parent, follows parents once more, and
    contracts the edges to what still joins different trees. Nodes that aren't the smallest of
    their neighbours vanish, so at least half of them do and few rounds are needed; a round's
    joins see every edge once. Rounds end in written tables; only "any edge left?" reaches the
    driver. Hub nodes are plain equi-joins that adaptive skew handling may split, and the
    reduction before each shuffle is a partial ``min``.
    """
    edges = stash(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), what + "-edges")
    label = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("parent")), what + "-parents")
        upper = parent.select(F.col("node").alias("up"), F.col("parent").alias("root"))
        step = stash(parent.join(upper, F.col("parent") == F.col("up")).select("node", "root"), what + "-roots")
        if label is None:
            label = step.select("node", F.col("root").alias("component"))
        else:
            label = label.join(step.withColumnRenamed("node", "was"), F.col("component") == F.col("was"), "left").select("node", F.coalesce("root", "component").alias("component"))
        label = stash(label, what)
        first = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), F.col("u") == F.col("a"))
        second = first.join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), F.col("v") == F.col("b"))
        left = stash(second.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), what + "-edges")
        drop_stash(parent)
        drop_stash(edges)
        edges = left
        if not edges.limit(1).count():
            return label


#: Rows whose keys are searched together, about, and rows whose keys are packed together.
SHARD_ROWS, PACK_ROWS = 100_000, 1 << 16


def shared_keys(rows: DataFrame, columns, names: list[str], wide: bool, what: str, close=None, carried: dict | None = None, small: int = 256) -> DataFrame:
    """A written table (h, bucket) of the rows that share a key with another row.

    ``columns(batch)`` gives (table, indexes of rows, their keys) for every table; ``names`` are what it
    reads beside the row's hash ``h``. Keys of a table have 64 bits if ``wide``, else 32. They travel
    packed with the hash, to the shard of their key, where sorting finds the runs. Where rows of one
    pack share a key they are listed at once, and one of them goes to the shard for all, so a
    key that a third of all rows have is no larger there than the number of packs.

    Keys of few bits meet by chance, the more so the more rows there are. With ``close`` (as in ``block_links``)
    the columns ``carried`` (name: numpy type) travel too, and of a bucket of at most ``small`` rows only
    those are listed that ``close`` allows to be similar to another one; larger buckets stay whole.
    """
    carried = carried or {}
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    kind = np.dtype([("key", "<u8" if wide else "<u4"), ("h", "<i8"), ("known", "u1"), *carried.items()])

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        h = np.asarray(b.column("h"))
        out: dict[str, list] = {"t": [], "shard": [], "packed": []}

        def add(t: int, shard: int, part: np.ndarray) -> None:
            for c, x in (("t", t), ("shard", shard), ("packed", part.tobytes())):
                out[c].append(x)

        for t, mine, key in columns(b):
            order = np.argsort(key, kind="stable")
            row = np.zeros(len(key), kind)
            row["key"], row["h"] = key[order], h[mine[order]]
            for c in carried:
                row[c] = np.asarray(b.column(c))[mine[order]]
            new = np.append(True, row["key"][1:] != row["key"][:-1])
            if close:
                run = np.cumsum(new) - 1
                row["known"] = twin = (np.bincount(run) > small)[run]
            else:
                row["known"] = twin = ~(new & np.append(new[1:], True))
            if twin.any():
                add(t, -1 - int(row["h"][0]) % shards, row[twin])
            row = row[new | ~twin]
            shard = (mix64(row["key"].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            row = row[order]
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for j in np.flatnonzero(np.diff(edges)).tolist():
                add(t, j, row[edges[j] : edges[j + 1]])
        return pa.RecordBatch.from_arrays([pa.array(out["t"], pa.int32()), pa.array(out["shard"], pa.int32()), pa.array(out["packed"], pa.binary())], names=["t", "shard", "packed"])

    def send(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK_ROWS:
                yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def search(table: pa.Table) -> pa.Table:
        row = np.frombuffer(b"".join(table.column("packed").to_pylist()), kind)
        t = table.column("t")[0].as_py()
        if table.column("shard")[0].as_py() >= 0:
            row = row[np.argsort(row["key"], kind="stable")]
            same = row["key"][1:] == row["key"][:-1]
            row = row[np.append(False, same) | np.append(same, False)]
            if close and len(row):
                run = np.cumsum(np.append(True, row["key"][1:] != row["key"][:-1])) - 1
                large = (np.bincount(run) > small) | (np.bincount(run, row["known"]) > 0)
                row = row[near_rows(run, large[run], {c: np.ascontiguousarray(row[c]) for c in carried}, close)]
            row = row[row["known"] == 0]
        bucket = row["key"].astype(np.int64) + (0 if wide else t << 34)
        return pa.table({"h": pa.array(row["h"].copy()), "bucket": pa.array(bucket)})

    packed = rows.select("h", *dict.fromkeys([*names, *carried])).mapInArrow(send, "t int, shard int, packed binary")
    return stash(packed.groupBy("t", "shard").applyInArrow(search, "h long, bucket long"), what)


def near_rows(bucket: np.ndarray, whole: np.ndarray, data: dict, close) -> np.ndarray:
    """Which rows are in a ``whole`` bucket or may be similar, by ``close``, to another row of theirs; buckets lie in a row."""
    keep, live, lag = whole.copy(), np.flatnonzero(~whole), 1
    while len(live := live[live + lag < len(bucket)]) and len(live := live[bucket[live] == bucket[live + lag]]):
        ok = live[close(data, live, live + lag)]
        keep[ok] = keep[ok + lag] = True
        lag += 1
    return keep


#: Members of a bucket that a task compares with those of one other block of it.
BLOCK = 4096
#: Pairs of a large bucket that are decided at once, where many are.
PAIRS = 1 << 15
#: Members of small buckets that one task of ``block_links`` looks at, about, and the largest small bucket.
TASK_MEMBERS, SMALL = 20_000, 256


def fitting(at: DataFrame, near: DataFrame, close, small: int = SMALL) -> DataFrame:
    """The rows of ``at`` (bucket, node, ...) that ``close`` allows to be similar to another row of their bucket.

    Keys of few bits meet by chance, the more so the more rows there are; such members need no text.
    ``close(columns as arrays, i, j)`` is as in ``block_links``. Buckets that hold more than ``small`` rows of
    ``near`` (bucket, ...) stay whole, and their rows are dealt to any task.
    """
    large = near.groupBy("bucket").agg(F.count("*").alias("__n")).where(F.col("__n") > small).select("bucket", F.lit(True).alias("__large"))
    flagged = at.join(large, "bucket", "left").withColumn("__large", F.coalesce("__large", F.lit(False)))
    names = at.columns
    dealt = flagged.repartition("bucket", F.when(F.col("__large"), F.xxhash64("node"))).sortWithinPartitions("bucket")

    def screen(b: pa.RecordBatch) -> pa.RecordBatch:
        data = {c: np.asarray(b.column(c)) for c in names if c != "node"}
        return b.select(names).filter(pa.array(near_rows(data["bucket"], np.array(b.column("__large")), data, close)))

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one small bucket that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            bucket = np.asarray(b.column("bucket"))
            cut = b.num_rows if b.column("__large")[b.num_rows - 1].as_py() else int(np.searchsorted(bucket, bucket[-1]))
            held = [b.slice(cut)] if cut < b.num_rows else []
            yield screen(b.slice(0, cut))
        if held:
            yield screen(held[0])

    return dealt.mapInArrow(run, at.schema)


def bucket_links(at: DataFrame, fits, verify, close, decide, what: str, detail: DataFrame | None = None, block: int = BLOCK, many: bool = False) -> DataFrame:
    """(node, component) of what similar pairs of a bucket connect; nodes without a link are not listed.

    ``at`` has (bucket, node, size, and whatever ``fits`` compares); ``fits(a, b)`` is a cheap
    condition on the fields of two structs; ``verify(pairs)`` keeps the truly similar pairs (u, v).

    1. Every node meets the smallest of its buckets' smallest members: one pair a node, so a group of
       copies that shares many buckets costs one comparison a member.
    2. Members of buckets that still hold several components meet their bucket's smallest member.
    3. Of what is then still apart, every pair of a bucket that ``close`` doesn't rule out is compared where
       the bucket's members meet, by ``decide``, unless earlier links of the task connect it already.

    Nothing is capped: the third turn is exact, a task of it holds two blocks of a bucket at most, and
    it returns no more links than it has components.
    """
    extra = [c for c in at.columns if c not in ("bucket", "node", "size")]
    item = F.struct("size", "node", *extra)
    buckets = at.groupBy("bucket").agg(F.min(item).alias("hub"), F.max("node").alias("last"), F.min("node").alias("first")).where("first != last")
    members = stash(at.join(buckets.select("bucket", "hub"), "bucket").select("bucket", item.alias("item"), "hub"), what + "-members")
    one, hub = F.col("item"), F.col("hub")
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    met = members.where((one["node"] != hub["node"]) & fits(one, hub)).groupBy(one["node"].alias("u")).agg(F.min(F.struct(hub["size"], hub["node"]))["node"].alias("v"))
    tested = stash(ordered(met).distinct(), what + "-pairs")
    label = components(verify(tested), what + "-classes")

    def merge(label: DataFrame, links: DataFrame) -> DataFrame:
        links = stash(links, what + "-links")
        if links.limit(1).count():
            label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), what + "-classes")
        drop_stash(links)
        return label

    def apart(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The members of buckets with several components, each with its own and the smallest member's."""
        named = rows.select("bucket", "item").join(label, one["node"] == label["node"], "left").select("bucket", "item", F.coalesce("component", one["node"]).alias("comp"))
        split = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("item", "comp")).alias("hub")).where("low != high")
        return stash(named.join(split.select("bucket", "hub"), "bucket"), what + "-apart")

    second = apart(members, label)
    drop_stash(members)
    pairs = second.where((F.col("comp") != F.col("hub.comp")) & fits(one, F.col("hub.item"))).select(one["node"].alias("u"), F.col("hub.item.node").alias("v"))
    fresh = stash(ordered(pairs).distinct().join(tested, ["u", "v"], "left_anti"), what + "-pairs")
    label = merge(label, verify(fresh))
    third = apart(second, label)
    drop_stash(second)
    label = merge(label, block_links(third.select("bucket", "item.*", "comp"), close, decide, detail, block, many))
    drop_stash(third)
    return label


def block_links(members: DataFrame, close, decide, detail: DataFrame | None = None, block: int = BLOCK, many: bool = False) -> DataFrame:
    """Links (u, v) that connect what similar members of a bucket connect, of members in different components.

    ``members`` has (bucket, node, size, comp, ...), ``detail`` more columns for each node.
    ``close(table, i, j)`` gets a task's columns as arrays and says for which k row ``i[k]`` may be
    similar to row ``j[k]``; ``decide(table, i, j)`` says it of one pair for certain, or with ``many`` of
    the pairs of two arrays. Small buckets share a task; large ones are cut into blocks by hash, and a task compares two blocks. A pair that shares
    several buckets is decided in the least of them.
    """
    counts = members.groupBy("bucket").agg(F.count("*").alias("n"))
    mine = members.join(counts.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"), (F.col("n") > SMALL).alias("large")), "bucket")
    mine = mine.withColumn("p", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    spread = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumns({"low": F.least("p", "o"), "high": F.greatest("p", "o")})
    tasks = max(1, members.count() // TASK_MEMBERS)
    task = F.when(F.col("large"), F.xxhash64("bucket", "low", "high")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(tasks)))
    spread = spread.withColumn("task", task).drop("o", "parts", "large")
    full = spread.join(members.groupBy("node").agg(F.collect_set("bucket").alias("shared")), "node")
    full = full if detail is None else full.join(detail, "node")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")])
        data = {}
        for name in table.column_names:
            column = table.column(name).combine_chunks()
            if name == "shared":
                continue
            if pa.types.is_list(column.type):
                data[name] = np.asarray(column.flatten()).reshape(table.num_rows, -1)
            elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                data[name] = column
            elif name not in ("node", "comp"):
                data[name] = np.asarray(column)
        comp = np.asarray(table.column("comp").combine_chunks().dictionary_encode().indices)
        p, low, high, bucket = (data[c] for c in ("p", "low", "high", "bucket"))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        run = np.cumsum(new)
        # the buckets of every row by rank, and (row, rank) in order
        lists = table.column("shared").combine_chunks()
        count = np.diff(np.asarray(lists.offsets))
        values, rank = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        own = np.sort(np.repeat(np.arange(len(count)), count) * len(values) + rank)
        base, here = np.cumsum(count) - count, np.searchsorted(values, bucket)

        def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether rows i and j share no bucket less than the one they meet in."""
            less = np.searchsorted(own, i * len(values) + here[i]) - base[i]
            pair = np.repeat(np.arange(len(i)), less)
            wanted = own[np.arange(len(pair)) + np.repeat(base[i] - (np.cumsum(less) - less), less)] + (j - i)[pair] * len(values)
            out = np.ones(len(i), bool)
            out[pair[own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted]] = False
            return out

        found: list[tuple[int, int]] = []
        tree = list(range(int(comp.max()) + 1))

        def root(c: int) -> int:
            while tree[c] != c:
                tree[c] = c = tree[tree[c]]
            return c

        def take(i: np.ndarray, j: np.ndarray) -> None:
            differ = comp[i] != comp[j]
            i, j = i[differ], j[differ]
            if not len(i):
                return
            ok = close(data, i, j)
            i, j = i[ok], j[ok]
            ok = least(i, j)
            i, j = i[ok], j[ok]
            if many and len(i):
                tops = {c: root(c) for c in np.unique(comp[np.concatenate([i, j])]).tolist()}
                ok = np.array([tops[x] != tops[y] for x, y in zip(comp[i].tolist(), comp[j].tolist(), strict=True)])
                i, j = i[ok], j[ok]
                ok = decide(data, i, j)
                i, j = i[ok], j[ok]
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = root(comp[a]), root(comp[b])
                if x != y and (many or decide(data, a, b)):
                    tree[x] = y
                    found.append((a, b))

        size = np.bincount(run)[run]
        live, lag = np.flatnonzero(size <= SMALL), 1
        while len(live := live[live + lag < len(run)]) and len(live := live[run[live] == run[live + lag]]):
            take(live, live + lag)
            lag += 1
        for r in np.unique(run[size > SMALL]).tolist():
            at = np.flatnonzero(run == r)
            left, right = at[p[at] == low[at[0]]], at[p[at] == high[at[0]]]
            one = low[at[0]] == high[at[0]]
            done, step = 0, 1
            while done < len(left):
                # pairs decided at once don't see each other's links: more rows together only while none are found
                some, before = left[done : done + step], len(found)
                begin = np.searchsorted(right, some, side="right") if one else np.zeros(len(some), np.int64)
                n = len(right) - begin
                take(np.repeat(some, n), right[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)])
                done += step
                step = min(2 * step, max(1, PAIRS // len(right))) if many and len(found) == before else 1
        node = table.column("node").combine_chunks()
        u, v = (node.take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    return full.groupBy("task").applyInArrow(compare, "u binary, v binary")
