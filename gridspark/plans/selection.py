"""Splits and cross-validation: folds are columns, decided on the driver from block sizes alone."""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.blocks import block_split
from gridspark.plans.base import Gridder, region_of
from gridspark.plans.solve import Moments, metric
from gridspark.plans.trend import FittedTrend, Trend
from gridspark.scratch import settle
from gridspark.spec import SpatialFrame


def partition_by_sum(values, parts: int) -> np.ndarray:
    """Where to cut an array, in order, into parts of about equal sum."""
    values = np.ravel(values)
    if parts > values.size:
        raise ValueError(f"{values.size} values can't make {parts} parts")
    # a cut comes after all values whose running sum is within so many whole shares
    running = np.cumsum(values)
    share = running[-1] // parts
    cuts = np.array([np.count_nonzero(running <= k * share) for k in range(1, parts)], int)
    if (np.diff(cuts) == 0).any():
        raise ValueError(f"No cut of the values gives {parts} parts of about equal sum")
    return cuts


def random_split(n: int, rng: np.random.RandomState, test_size=0.1, train_size=None) -> tuple[np.ndarray, np.ndarray]:
    """(train, test) positions: a permutation whose head is the test set. Fractions round up for test, down for train."""
    n_test = math.ceil(test_size * n) if isinstance(test_size, float) else int(test_size)
    n_train = n - n_test if train_size is None else math.floor(train_size * n) if isinstance(train_size, float) else int(train_size)
    if n_test < 1 or n_train < 1 or n_test + n_train > n:
        raise ValueError(f"{n} items can't be split into {n_train} to train and {n_test} to test")
    order = rng.permutation(n)
    return order[n_test : n_test + n_train], order[:n_test]


def equal_folds(n: int, k: int) -> list[np.ndarray]:
    return np.array_split(np.arange(n), k)


def _rng(seed) -> np.random.RandomState:
    return seed if isinstance(seed, np.random.RandomState) else np.random.RandomState(seed)


class BlockCrossValidator(ABC):
    """Splits by blocks of ``spacing`` or ``shape``. Subclasses choose blocks from their sizes."""

    def __init__(self, spacing=None, shape=None, n_splits=10):
        if spacing is None and shape is None:
            raise ValueError("Give either spacing or shape of the blocks")
        self.spacing, self.shape, self.n_splits = spacing, shape, n_splits

    def get_n_splits(self) -> int:
        return self.n_splits

    @abstractmethod
    def choose(self, blocks: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Block ids of every test set."""

    def _blocked(self, df: DataFrame, coords):
        _, labelled = block_split(df, coords, spacing=self.spacing, shape=self.shape)
        # one row per block that has points: the blocks of a lattice, not the data
        rows = labelled.groupBy("block").count().orderBy("block").collect()
        return labelled, self.choose(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))

    def split_table(self, df: DataFrame, coords=("easting", "northing")) -> tuple[DataFrame, DataFrame]:
        """(points with block, table (split, block) of the test sets)."""
        labelled, tests = self._blocked(df, coords)
        rows = [(k, int(b)) for k, t in enumerate(tests) for b in t]
        return labelled, df.sparkSession.createDataFrame(rows, "split int, block long")

    def splits(self, df: DataFrame, coords=("easting", "northing")) -> list[tuple[DataFrame, DataFrame]]:
        """(train, test) DataFrames of every split: a join with that split's few blocks."""
        labelled, table = self.split_table(df, coords)
        out = []
        for k in range(self.n_splits):
            mine = F.broadcast(table.where(F.col("split") == k).select("block"))  # at most the lattice's blocks
            out.append((labelled.join(mine, "block", "left_anti").drop("block"), labelled.join(mine, "block", "left_semi").drop("block")))
        return out


class BlockShuffleSplit(BlockCrossValidator):
    """Random blocks for testing; of ``balancing`` draws the one whose points are split most like its blocks."""

    def __init__(self, spacing=None, shape=None, n_splits=10, test_size=0.1, train_size=None, random_state=None, balancing=10):
        super().__init__(spacing, shape, n_splits)
        if balancing < 1:
            raise ValueError(f"balancing is one at least, not {balancing}")
        self.test_size, self.train_size, self.random_state, self.balancing = test_size, train_size, random_state, balancing

    def choose(self, blocks, sizes):
        rng, out = _rng(self.random_state), []
        for _ in range(self.n_splits):
            draws = [random_split(len(blocks), rng, self.test_size, self.train_size) for _ in range(self.balancing)]
            off = [abs(sizes[a].sum() / sizes[b].sum() - len(a) / len(b)) for a, b in draws]
            out.append(blocks[draws[int(np.argmin(off))][1]])
        return out


class BlockKFold(BlockCrossValidator):
    """Folds of blocks, balanced by their points where that's possible."""

    def __init__(self, spacing=None, shape=None, n_splits=5, shuffle=False, random_state=None, balance=True):
        super().__init__(spacing, shape, n_splits)
        if n_splits < 2:
            raise ValueError(f"Two folds are needed at least, not {n_splits}")
        self.shuffle, self.random_state, self.balance = shuffle, random_state, balance

    def choose(self, blocks, sizes):
        if self.n_splits > len(blocks):
            raise ValueError(f"{len(blocks)} blocks can't make {self.n_splits} folds")
        order = np.arange(len(blocks))
        if self.shuffle:
            _rng(self.random_state).shuffle(order)
        folds = equal_folds(len(blocks), self.n_splits)
        if self.balance:
            try:
                folds = np.split(np.arange(len(blocks)), partition_by_sum(sizes[order], self.n_splits))
            except ValueError:
                warnings.warn("Folds can't be balanced by points; they have equal numbers of blocks", UserWarning, stacklevel=3)
        return [blocks[order[f]] for f in folds]


def dealt(keys, seed: int | None = None):
    """A number in 0..2 ** 28 - 1 from an md5 of the keys: the same in every engine, for any number of rows."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed or 0)), *[F.col(k).cast("string") for k in keys])), 1, 7), 16, 10).cast("long")


@dataclass(frozen=True)
class KFold:
    """Folds of points by their dense rank in the order of ``id_col`` (or of the coordinates).

    Seeded shuffles repeat NumPy's draws and so need the number of points on the driver; ``hashed=True``
    deals points by a hash of their id instead, for any number.
    """

    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None
    id_col: str | None = None
    hashed: bool = False

    def fold(self, df: DataFrame, coords=("easting", "northing")) -> DataFrame:
        keys = [self.id_col] if self.id_col else list(coords)
        if self.hashed:
            return df.withColumn("fold", (dealt(keys, self.random_state) % self.n_splits).cast("int"))
        n = df.count()
        if self.n_splits > n:
            raise ValueError(f"{n} points can't make {self.n_splits} folds")
        order = np.arange(n)
        if self.shuffle:
            _rng(self.random_state).shuffle(order)
        fold = np.zeros(n, int)
        for k, part in enumerate(equal_folds(n, self.n_splits)):
            fold[order[part]] = k
        return with_lookup(df, keys, fold.tolist(), "fold")

    def splits(self, df: DataFrame, coords=("easting", "northing")):
        folded = self.fold(df, coords)
        return [(folded.where(F.col("fold") != k).drop("fold"), folded.where(F.col("fold") == k).drop("fold")) for k in range(self.n_splits)]


def with_rank(df: DataFrame, keys) -> DataFrame:
    """Adds ``__rank``: dense positions in the order of ``keys``, without a single-partition sort.

    Range partitions are sorted and counted; a running sum over the few partition counts gives offsets.
    """
    parts = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").count()
    offsets = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__offset"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__offset") + F.col("__local") - 1).drop("__part", "__offset", "__local")


def with_lookup(df: DataFrame, keys, values: list, name: str) -> DataFrame:
    """Adds the value at each row's rank in the order of ``keys``."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(values)), f"__rank long, {name} int")
    return with_rank(df, keys).join(table, "__rank").drop("__rank")


def train_test_split(frame: SpatialFrame, spacing=None, shape=None, test_size=0.1, train_size=None, random_state=None, id_col=None, hashed=False, **how) -> tuple[SpatialFrame, SpatialFrame]:
    """(train, test): random points, or random blocks of points if spacing or shape is given.

    Exact draws of points need the number of rows on the driver; ``hashed`` deals each point by a hash of
    its id (or coordinates) instead, so that the shares hold on average, for any number.
    """
    if spacing is not None or shape is not None:
        cv = BlockShuffleSplit(spacing, shape, 1, test_size, train_size, random_state, **how)
        train, test = cv.splits(frame.df, frame.coords)[0]
    elif hashed:
        place = dealt([id_col] if id_col else list(frame.coords), random_state) / F.lit(float(1 << 28))
        last = 1.0 if train_size is None else test_size + train_size
        if not (0 < test_size < last <= 1):
            raise ValueError(f"Hashed shares are fractions, not {test_size} to test and {train_size} to train")
        train, test = frame.df.where((place >= test_size) & (place < last)), frame.df.where(place < test_size)
    else:
        n = frame.df.count()
        role = np.zeros(n, int)
        a, b = random_split(n, _rng(random_state), test_size, train_size)
        role[a], role[b] = 1, 2
        marked = with_lookup(frame.df, [id_col] if id_col else list(frame.coords), role.tolist(), "__role")
        train, test = (marked.where(F.col("__role") == k).drop("__role") for k in (1, 2))
    return frame.on(train), frame.on(test)


#: Rows that a splitter by positions may see: their coordinates are on the driver.
MAX_POSITIONS = 1_000_000


def index_splits(cv, df: DataFrame, coords=("easting", "northing")) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) DataFrames of ``cv.split(X)``, which gives positions of X's rows: coordinates in their order.

    Such a splitter needs all coordinates on the driver and is refused above ``MAX_POSITIONS`` rows.
    """
    ranked = settle(with_rank(df, list(coords[:2])))
    rows = ranked.select("__rank", *coords[:2]).orderBy("__rank").limit(MAX_POSITIONS + 1).collect()
    if len(rows) > MAX_POSITIONS:
        raise ValueError(f"More than {MAX_POSITIONS} rows for a splitter by positions: use KFold(hashed=True) or a block splitter")
    out = []
    for train, test in cv.split(np.array([tuple(r)[1:] for r in rows], float)):
        role = np.zeros(len(rows), int)
        role[train], role[test] = 1, 2
        table = df.sparkSession.createDataFrame(list(enumerate(role.tolist())), "__rank long, __role int")
        marked = ranked.join(table, "__rank").drop("__rank")
        out.append(tuple(marked.where(F.col("__role") == k).drop("__role") for k in (1, 2)))
    return out


def cross_val_score(gridder: Gridder, frame: SpatialFrame, cv=None, scoring: str | Callable | None = None, delayed: bool = False):
    """Scores of every split: fit on its train part, score on its test part; ``delayed`` gives functions to call.

    ``scoring`` is a name or a function of (fitted gridder, test frame). ``cv`` gives DataFrames
    (``splits``) or, as other libraries' do, positions of rows (``split``): see ``index_splits``.

    Trends over point folds need no fit per fold: the power sums of each fold come from one
    aggregation, and a fold's training sums are the total less its own.
    """
    if scoring is None:
        warnings.warn("The default score will become the negative root mean squared error", FutureWarning, stacklevel=2)
        scoring = "r2"
    cv = KFold(5, shuffle=True, random_state=0) if cv is None else cv
    if isinstance(gridder, Trend) and isinstance(cv, KFold) and isinstance(scoring, str) and not delayed:
        return _trend_scores(gridder, frame, cv, scoring)

    def run(train, test):
        model = gridder.fit(frame.on(train))
        return model.score(frame.on(test), scoring)

    parts = cv.splits(frame.df, frame.coords) if hasattr(cv, "splits") else index_splits(cv, frame.df, frame.coords)
    jobs = [lambda a=a, b=b: run(a, b) for a, b in parts]
    return jobs if delayed else np.array([job() for job in jobs])


def _trend_scores(trend: Trend, frame: SpatialFrame, cv: KFold, scoring: str) -> np.ndarray:
    folded = cv.fold(frame.clean(), frame.coords).cache()
    moments = Moments(trend.degree, region_of(frame.on(folded)))
    rows = [r.asDict() for r in folded.groupBy("fold").agg(*moments.aggregates(frame.coords, frame.data, frame.weights)).collect()]
    total = {k: sum(r[k] or 0.0 for r in rows) for k in rows[0] if k != "fold"}
    scores = []
    for k in range(cv.n_splits):
        own = next((r for r in rows if r["fold"] == k), {})
        rest = {c: v - (own.get(c) or 0.0) for c, v in total.items()}
        out = folded.where(F.col("fold") == k)
        predicted = []
        for j in range(len(frame.data)):
            model = FittedTrend(degree=trend.degree, coef_=moments.coefficients(rest, j, frame.weights is not None))
            out = model.transform(out, frame.coords, [f"__p{j}"])
            predicted.append(f"__p{j}")
        scores.append(metric(out, scoring, frame.data, predicted, frame.weights))
    folded.unpersist()
    return np.array(scores)
