"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Every source gets a target in words; blocks of equal size go to sources by highest quotients
(target / (2 k + 1)), a source's blocks go to its shards the same way by shard size, and inside a
shard whole passes come first and then documents in a seeded order until the quota is spent.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its
own, after all others; repeated rows each count and each take their own share; an empty table gives an
empty result; columns other than ``doc_id``, ``text`` and ``source`` are ignored, and in a mixture a column
``taken`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a shard, on average; bounds what one window partition sorts.
SHARD_DOCS = 2000
#: Words of a block.
BLOCK_WORDS = 64
SEED = 11


def _hash(doc_id: Column, salt: str) -> Column:
    """The first 28 bits of an md5: the same number in every engine."""
    text = F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """Rows (source, source_size, docs, target): ``share`` of all words dealt by weight, none above ``most`` sizes.

    Sorted by most * size / weight, the capped sources are a prefix: a source is capped when its
    ratio is at most what is left for it and all after it, per unit of weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", cycle).withColumn("room", F.col("source_size") * F.lit(most))
    # ties in the ratio are capped together or not at all, so any order among them does
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / rest)
    final = level.withColumn("capped", F.col("room") <= F.col("level") * F.col("weight"))
    water = F.coalesce(F.min(F.when(~F.col("capped"), F.struct(F.col("room") / F.col("weight"), F.col("level")))).over(everything)["level"], F.lit(0.0))
    target = F.when(F.col("capped"), F.col("room")).otherwise(water * F.col("weight"))
    return final.select("source", "source_size", "docs", target.alias("target"))


def sainte_lague(parties: DataFrame, key: list[str], votes: str, seats: Column, within: list[str]) -> DataFrame:
    """Adds ``won``: seats dealt by highest quotients votes / (2 k + 1) inside each group of ``within``.

    Only quotients near the cut are listed: with S parties and N seats a party's result lies
    within fair * S / 2N + 1/2 of its fair share, so all lists together have about 2 S rows.
    """
    group = Window.partitionBy(*within)
    fair = F.col(votes) * F.col("seats") / F.col("all_votes")
    slack = F.col(votes) / F.col("all_votes") * F.col("parties") / 2 + 0.5
    sure = F.greatest(F.floor(fair - slack), F.lit(0)).cast("long")
    counted = (
        parties.withColumn("seats", seats.cast("long"))
        .withColumn("all_votes", F.sum(votes).over(group))
        .withColumn("parties", F.count("*").over(group))
    )
    bounds = counted.withColumn("sure", F.when(F.col(votes) > 0, sure).otherwise(F.lit(0).cast("long"))).withColumn(
        "last", F.when(F.col(votes) > 0, F.ceil(fair + slack).cast("long")).otherwise(F.lit(0).cast("long"))
    ).withColumn("open", F.col("seats") - F.sum("sure").over(group))
    listed = bounds.select("*", F.explode_outer(F.when(F.col("last") > F.col("sure"), F.sequence("sure", F.col("last") - 1))).alias("k"))
    quotient = F.col(votes) / (2 * F.col("k") + 1)
    rank = F.row_number().over(group.orderBy(F.coalesce(quotient, F.lit(-1.0)).desc(), *key, "k"))
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("place") <= F.col("open")), 1).otherwise(0)) + F.first("sure")
    kept = [c for c in parties.columns if c not in key]
    return (
        listed.withColumn("place", rank)
        .groupBy(*key)
        .agg(*[F.first(c).alias(c) for c in kept], won.alias("won"))
    )


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0, seed: int = SEED,
        block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source)."""
    sizes = stash(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    by_source = targets(sizes, share, weights, most)
    # null-safe keys: a null source is a value like any other
    sourced = by_source.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("docs") / shard_docs).alias("shards"))
    shard = (_hash(F.col("doc_id"), f"shard-{seed}-") % F.col("shards")).cast("int")
    placed = sizes.join(sourced, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", shard.alias("shard"))

    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words)
    blocks = sainte_lague(by_source.select("source", "target"), ["source"], "target", seats, [])
    shards = placed.groupBy("source", "shard").agg(F.sum("size").cast("double").alias("shard_size"), F.first("target").alias("of_target"))
    won = blocks.select(F.col("source").alias("of"), F.col("won").alias("of_won"))
    dealt = sainte_lague(
        shards.join(won, F.col("source").eqNullSafe(F.col("of"))).drop("of"), ["source", "shard"], "shard_size", F.col("of_won"), ["source"]
    ).select(F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", (F.col("won") * block_words).alias("quota"))

    joined = placed.join(dealt, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
    order = Window.partitionBy("source", "shard").orderBy(_hash(F.col("doc_id"), f"order-{seed}-"), "doc_id", "size")
    passes = F.when(F.col("shard_size") > 0, F.least(F.floor(F.col("quota") / F.col("shard_size")), F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.least(F.col("quota"), F.col("shard_size") * F.lit(most)) - F.col("passes") * F.col("shard_size"), F.lit(0.0))
    room = F.greatest(F.least(F.col("rest") - F.col("before"), F.col("size")), F.lit(0)).cast("long")
    return (
        joined.withColumn("passes", passes)
        .withColumn("rest", rest)
        .withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + room).alias("taken"))
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with its columns kept and ``taken`` added: how often and how far each document is used."""
    taken = stash(mix(docs, **how).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), "taken"), "taken")
    docs = docs.drop("taken")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (size == F.col("__size"))
    twice = stash(taken.groupBy(F.col("__id").alias("__of"), F.col("__size").alias("__long")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "taken-twice")
    if not twice.limit(1).count():
        return docs.join(taken, same).drop("__id", "__size")
    # rows that share an id and a size are numbered on both sides, so that each gets one share
    number = lambda *by: F.row_number().over(Window.partitionBy("__id", "__size").orderBy(*by))
    again = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__long"))
    sized = docs.withColumns({"__id": F.col("doc_id"), "__size": size})
    once = sized.join(twice, again, "left_anti").drop("__id", "__size").join(taken.join(twice, again, "left_anti"), same).drop("__id", "__size")
    rows = sized.join(twice, again, "left_semi").withColumn("__n", number(F.xxhash64("text", "source")))
    shares = taken.join(twice, again, "left_semi").withColumn("__m", number("taken")).select(F.col("__id").alias("__of"), F.col("__size").alias("__long"), "__m", "taken")
    numbered = rows.join(shares, again & (F.col("__n") == F.col("__m"))).drop("__id", "__size", "__of", "__long", "__n", "__m")
    return once.unionByName(numbered)


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sizes GROUP BY source),
placed AS (SELECT *, CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS room FROM by_source),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM placed),
capped AS (SELECT *, room <= level * weight AS cap FROM levels),
targets AS (SELECT source, source_size, docs, CASE WHEN cap THEN room ELSE weight * (SELECT arg_min(level, room / weight) FROM capped WHERE NOT cap) END AS target FROM capped),
seats AS (SELECT CAST(round(sum(target) / {BLOCK_WORDS}) AS BIGINT) AS n FROM targets),
quotients AS (SELECT source, target / (2 * k + 1) AS q, k FROM targets, seats, range(0, n) r(k) WHERE k < ceil(target * n / (SELECT sum(target) FROM targets) + target / (SELECT sum(target) FROM targets) * (SELECT count(*) FROM targets) / 2 + 0.5)),
blocks AS (SELECT source, sum(CASE WHEN place <= n THEN 1 ELSE 0 END) AS won FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS FIRST, k) AS place FROM quotients), seats GROUP BY source),
sharded AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
  CAST(CAST('0x' || substr(md5('shard-{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) % CAST(ceil(t.docs / {SHARD_DOCS}.0) AS BIGINT) AS INTEGER) AS shard
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT source, shard, CAST(sum(size) AS DOUBLE) AS shard_size FROM sharded GROUP BY ALL),
shard_seats AS (SELECT s.*, coalesce(b.won, 0) AS n, sum(shard_size) OVER (PARTITION BY s.source) AS votes, count(*) OVER (PARTITION BY s.source) AS parties FROM shards s LEFT JOIN blocks b ON s.source IS NOT DISTINCT FROM b.source),
shard_quotients AS (SELECT source, shard, n, unnest(range(0, CAST(CASE WHEN shard_size > 0 THEN ceil(shard_size * n / votes + shard_size / votes * parties / 2 + 0.5) ELSE 0 END AS BIGINT))) AS k, shard_size FROM shard_seats),
dealt AS (SELECT source, shard, sum(CASE WHEN place <= n THEN 1 ELSE 0 END) * {BLOCK_WORDS} AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place FROM shard_quotients) GROUP BY ALL),
ordered AS (SELECT d.*, s.shard_size, coalesce(q.quota, 0) AS quota,
  coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY CAST('0x' || substr(md5('order-{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sharded d JOIN shards s ON d.source IS NOT DISTINCT FROM s.source AND d.shard = s.shard LEFT JOIN dealt q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard),
passed AS (SELECT *, CASE WHEN shard_size > 0 THEN least(floor(quota / shard_size), 2) ELSE 0 END AS passes FROM ordered)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(greatest(least(quota, shard_size * 2) - passes * shard_size, 0) - before, size), 0) AS BIGINT) AS taken FROM passed
"""
