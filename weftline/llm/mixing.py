"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Words are dealt in whole documents, documents in blocks: a block is what one hash value of
a source's documents holds, so blocks are random and disjoint by construction and need no
sort over a source. A source's target becomes an exact quota of block draws: so many whole
passes, then the first blocks of one more, the last of which is taken in part. A binary
tree over the output shards splits all sources' quotas at once: each node gives its left
half a multivariate-hypergeometric draw, so every shard is a fair sample of the mix and the
quotas add up exactly. Shards then take runs of each source's permuted blocks and order
their own documents by a hash.

Only DataFrame functions touch rows. The tree is drawn on the driver over one count for each
source, whatever the number of rows; blocks grow with the corpus, so that the counts stay in
the range of the exact sampler. Sources are few next to documents: their table, a row each,
is ordered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, fresh, quoted

# Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)

#: No document is taken more than so many times.
MOST = 3
#: Words of a block, about, and the most blocks of one source.
BLOCK_WORDS = 8192
MOST_BLOCKS = 1 << 16
#: Blocks of all sources, about, up to which a block has BLOCK_WORDS; beyond, blocks grow.
ALL_BLOCKS = 1 << 27
SHARDS = 16
SEED = 20240


def words(text: Column) -> Column:
    """Number of words that ASCII white space separates; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to a frame of one row per (source, source_size).

    Sources by code point, a null last, weigh ``weights`` in turn and share all words; what
    exceeds ``most`` times a source is shared by weight among the others. That is the level
    at which water stands in vessels of height most * size and width weight: with sources in
    order of height over width, the first that is not full gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = (F.col("source_size") * F.lit(float(most))).alias("cap")
    rows = sources.select("*", F.get(F.array(*map(F.lit, weights)), turn).alias("w"), cap)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    rows = rows.select("*", (rest / open_w).alias("level"), F.row_number().over(up).alias("turn"))
    level = F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("turn"))).over(every)
    full = F.coalesce(level * F.col("w") > F.col("cap"), F.lit(True))
    return rows.withColumn("target", F.when(full, F.col("cap")).otherwise(level * F.col("w"))).drop("w", "cap", "level", "turn")


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """For each shard (row), how many of each source's draws it gets; sums are exact.

    Sizes of shards differ by one draw at most. Each node of the tree is an exact
    multivariate-hypergeometric draw, which takes up to 10^9 draws in all.
    """
    q = np.asarray(quotas, np.int64)
    if shards == 1:
        return q[None]
    rng = np.random.Generator(np.random.PCG64([seed, shards, int(q.sum()), len(q)]))
    left = rng.multivariate_hypergeometric(q, int(q.sum()) * (shards // 2) // shards, method="marginals")
    return np.concatenate([splitting_tree(left, shards // 2, 2 * seed), splitting_tree(q - left, shards - shards // 2, 2 * seed + 1)])


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    whole: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, ``size``, ``source_size``, ``target``, ``taken``, ``draws``.

    ``keep`` names more columns of the input to pass, which are moved between tasks once.

    ``draws`` is an array of (shard, place, words), one for each time that the document is
    taken; ``place`` orders a shard. ``taken`` sums its words. At most one document of a
    source is taken in part, its first words, so that the source's sum is its target to the
    word. With ``whole`` no document is taken in part: a source ends at the boundary of a
    document that is nearest its target, the later of two, but a source with a target has one
    document at least. A null source is a source of its own; documents without words have no draws; rows
    that repeat an id are dealt together but counted each; texts of any length are read
    whole. An empty table gives an empty result; other columns are ignored. The same rows
    give the same mix in any order.
    """
    key = F.xxhash64(F.lit(seed), F.col("id"))
    sized = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).cast("string").alias("source"), words(F.col(quoted(text_col))).alias("size"), *[F.struct(*[F.col(quoted(c)) for c in keep]).alias("kept")] * bool(keep))
    docs = cut(sized.select("id", "source", "size"))
    totals = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = totals.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(block_words, every // ALL_BLOCKS)
    goal = targets(totals, weights, most)
    passes = F.least(F.floor(F.round("target") / F.greatest("source_size", F.lit(1))), F.lit(most)).cast("bigint")
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)), F.lit(MOST_BLOCKS)).cast("bigint")
    goal = goal.select("*", passes.alias("passes"), blocks.alias("n_blocks"))
    rest = (F.round("target") - F.col("passes") * F.col("source_size")).cast("bigint")
    if whole:
        rest = F.when((F.col("passes") == 0) & (F.col("target") > 0), F.greatest(rest, F.lit(1))).otherwise(rest)
    goal = cut(goal.withColumn("rest", rest))

    def placed(rows: DataFrame) -> DataFrame:
        met = rows.alias("d").join(F.broadcast(goal) if _few(goal) else goal, F.col("d.source").eqNullSafe(goal["source"])).drop(goal["source"])
        return met.withColumn("block", F.pmod(key, F.col("n_blocks")))

    dealt = placed(docs)
    in_source = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "block", "rest").agg(F.sum("size").alias("block_size"))
    sums = sums.select("source", "block", "rest", "block_size", F.coalesce(F.sum("block_size").over(in_source), F.lit(0)).alias("before"))
    extra = F.when(F.col("before") + F.col("block_size") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    sums = cut(sums.select("source", "block", "before", extra.alias("extra")))

    quotas = goal.join(sums.groupBy(F.col("source").alias("s")).agg(F.max(F.when(F.col("extra") > 0, F.col("block") + 1).otherwise(0)).alias("more")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    quotas = cut(quotas.select("source", turn.alias("turn"), (F.col("passes") * F.col("n_blocks") + F.col("more")).alias("quota")))
    # one number for each source
    counts = [r[0] for r in quotas.orderBy("turn").select("quota").toLocalIterator()]
    ends = np.cumsum(splitting_tree(counts, shards, seed), axis=0) if counts else np.zeros((shards, 0), np.int64)
    bounds = docs.sparkSession.createDataFrame([(i, e) for i, e in enumerate(ends.T.tolist())], "b_turn int, ends array<bigint>")
    shares = quotas.join(F.broadcast(bounds) if len(counts) <= FEW_SOURCES else bounds, F.col("turn") == F.col("b_turn")).select(F.col("source").alias("q_source"), "ends")
    plan = sums.join(F.broadcast(shares) if _few(quotas) else shares, F.col("source").eqNullSafe(F.col("q_source")))
    plan = plan.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "before", "extra", "ends")

    rows = (placed(sized) if keep else dealt).join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    within = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), F.col("id")), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    some = F.least(F.greatest(lead, F.lit(0)), F.col("size"))
    if whole:
        first_of_all = (F.col("passes") == 0) & (lead == F.col("rest"))
        some = F.when((lead > 0) & ((2 * lead >= F.col("size")) | first_of_all), F.col("size")).otherwise(F.lit(0))
    part = F.when(F.col("extra") == 2, F.col("size")).when(F.col("extra") == 1, some).otherwise(F.lit(0))
    rows = rows.withColumn("part", part.cast("bigint"))

    def draw(turn: Column, n: Column) -> Column:
        # pass t of a source takes its blocks in order, after those of the passes before it
        at = turn * F.col("n_blocks") + F.col("block")
        shard = F.size(F.filter("ends", lambda e: e <= at))
        return F.struct(shard.alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("id"), turn).alias("place"), n.alias("words"))

    whole = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes").cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda t: draw(t.cast("bigint"), F.col("size")))
    draws = F.filter(F.concat(whole, F.array(draw(F.col("passes"), F.col("part")))), lambda x: x["words"] > 0)
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    rows = rows.select("id", "source", "size", "source_size", "target", *["kept"] * bool(keep), draws.alias("draws")).select("*", taken.alias("taken"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "draws", *[F.col("kept")[c].alias(c) for c in keep])


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, always whole, each as often as the mix takes it.

    Rows stand by shard and, in a shard, in its order, within each partition; a shard is
    spread over all partitions, so none is larger than another. Rows that repeat an id, or
    have none, are taken each for itself; nulls and blanks as in mix().
    """
    shard, place = fresh(df, "shard", "place")
    out = mix(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"), F.col(quoted(source_col)).alias("s"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")), "id", "t", "s", whole=True, keep=("row",), **options)
    out = out.select("row", F.inline("draws")).select("row.*", F.col("shard").alias(shard), F.col("place").alias(place))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, shard, F.pmod(place, F.lit(n))).sortWithinPartitions(shard, place).drop(shard, place)


#: Sources up to which their table is broadcast; beyond it the join shuffles.
FEW_SOURCES = 10_000


def _few(sources: DataFrame) -> bool:
    return len(sources.limit(FEW_SOURCES + 1).select(F.lit(1)).collect()) <= FEW_SOURCES


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the draws: shard, place in it and words."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "draws")
