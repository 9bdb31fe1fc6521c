"""Near-duplicate detection with SetSketch registers.

A register is the exponentially spaced, truncated minimum of one hash over a text's
shingles: floor(1 - log_b x) of the least exponential variate x. Registers of a union are
the larger ones, and two texts agree in one with about the probability of their Jaccard
similarity. Texts that agree in all registers of a band are candidates; the joint likelihood
of which registers are larger, equal or smaller drops the hopeless ones; the rest are
confirmed on their full shingle sets.

Equal sets are one class from the start, so copies cost nothing. In a band's bucket each
class is first compared with the smallest one only, which joins most of what belongs
together. What buckets still hold in different components is gathered once for each family
of connected buckets and compared in blocks of about as many shingles: a large component has
blocks of its own, which are not compared with each other, small ones share blocks. A task
sees two blocks that have a bucket in common. No pair that shares a band and joins two
components goes unlooked at, and no pair becomes a row before it is confirmed.

A pair can be lost in two ways: no band agrees, or the estimate falls ``SLACK`` standard
errors short. At a similarity of 0.85 these have a probability of 8e-7 and about 1e-9, at 0.80
of 7e-5 and about 1e-9; more similar pairs are lost less often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bitmap, by_batch, cut, mark, quoted, slot
from weftline.llm.graph import components
from weftline.llm.shingles import mixed, sets

#: Registers are BANDS bands of ROWS. At similarity 0.85 all bands miss in one of 10^6.
BANDS, ROWS = 24, 5
#: Base, rate and last value of the registers.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Standard errors by which an estimate may fall short before a pair is dropped unconfirmed.
SLACK = 6.0
#: Shingles of a block of classes, and what a class counts at least.
BLOCK_SHINGLES, LEAST_SHINGLES = 1 << 16, 256
#: Bits of the filter that tells which texts are needed in full.
FILTER_BITS = 1 << 24

FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of shingle hashes."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * FACTORS).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    rows = r.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of largest likelihood for rows of registers and set sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def digest(packed: bytes) -> np.ndarray:
    """128 bits of a packed set's hash, as two numbers."""
    return np.frombuffer(hashlib.blake2b(packed, digest_size=16).digest(), np.int64)


def sketch(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (shingles), s1 and s2 (128 bits of the set's hash), bands, registers; null if empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, s1, s2, bands, regs = [], [], [], [], []
        for s in sets(batch.column(1).to_pylist(), width):
            n.append(len(s))
            if not len(s):
                for x in (s1, s2, bands, regs):
                    x.append(None)
                continue
            d = digest(s.tobytes())
            r = registers(s)
            s1.append(int(d[0]))
            s2.append(int(d[1]))
            bands.append(band_keys(r))
            regs.append(r.tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, s1, s2, bands, regs), kinds)], names=["id", "n", "s1", "s2", "bands", "registers"])

    rows = df.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(by_batch(run), "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, registers binary")


def full_sets(df: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> DataFrame:
    """id, s1 and packed set of the texts whose id is in ``needed``, and of a few others."""
    filt = bitmap(needed.select(slot(bits, F.col("id")).alias("at")), "at")
    rows = df.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = mark(rows, slot(bits, F.col("id")), filt, "wanted").where("wanted").select("id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in sets(batch.column(1).to_pylist(), width)]
        s1 = [int(digest(x)[0]) for x in packed]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1, pa.int64()), pa.array(packed, pa.binary())], names=["id", "s1", "set"])

    return rows.mapInArrow(by_batch(run), "id bigint, s1 bigint, set binary")


def _floor(percent: int) -> float:
    """Estimates below it are hopeless."""
    least = percent / 100
    return least - SLACK * (least * (1 - least) / (BANDS * ROWS)) ** 0.5


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes and registers allow the similarity asked for."""
    m, floor = BANDS * ROWS, _floor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, v, n_u, n_v = (b.column(k).to_numpy() for k in range(4))
            r = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, m) for k in (4, 5)]
            good = (100 * np.minimum(n_u, n_v) >= percent * np.maximum(n_u, n_v)) & (joint_estimate(*r, n_u, n_v) >= floor)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])

    a = nodes.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("registers").alias("r_u"))
    b = nodes.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("registers").alias("r_v"))
    met = pairs.join(a, "u").join(b, "v")
    return met.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(run, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), percent) for pair in zip(b.column(2), b.column(3), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    met = pairs.join(stored.select(F.col("id").alias("u"), F.col("set").alias("s_u")), "u").join(stored.select(F.col("id").alias("v"), F.col("set").alias("s_v")), "v")
    return met.select("u", "v", "s_u", "s_v").mapInArrow(run, "u bigint, v bigint")


def _open_buckets(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (band, id, label, ...) of buckets that hold at least two components."""
    columns = buckets.columns
    if labels is not None:
        known = labels.select(F.col("id").alias("l_id"), F.col("label").alias("found"))
        buckets = buckets.join(known, F.col("id") == F.col("l_id"), "left").withColumn("label", F.coalesce("found", "id"))
    ends = buckets.groupBy(F.col("band").alias("e_band")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return buckets.join(ends, F.col("band") == F.col("e_band")).select(*columns)


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    x = np.concatenate([p, q])
    x.sort(kind="stable")  # two sorted runs: a merge
    both = int(np.count_nonzero(x[1:] == x[:-1]))
    return 100 * both >= percent * (len(p) + len(q) - both)


def block_links(a: list[dict], b: list[dict] | None, percent: int) -> list[tuple[int, int]]:
    """Links between classes of two blocks (or within one) that join different components."""
    m, other = BANDS * ROWS, a if b is None else b
    ra, rb = (np.frombuffer(b"".join(x["registers"] for x in side), np.uint16).reshape(-1, m) for side in (a, other))
    na, nb = (np.array([x["n"] for x in side], np.int64) for side in (a, other))
    la, lb = (np.array([x["label"] for x in side], np.int64) for side in (a, other))
    found: list[tuple[int, int]] = []
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    rows, cols = [], []
    for i in range(len(a)):
        open_ = (lb != la[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i]))
        if b is None:
            open_[: i + 1] = False
        j = np.flatnonzero(open_)
        j = j[(rb[j] == ra[i]).reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1)]
        rows.append(np.full(len(j), i))
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if not len(i):
        return found
    likely = joint_estimate(ra[i], rb[j], na[i], nb[j])
    at = np.argsort(-likely, kind="stable")
    at = at[likely[at] >= _floor(percent)]
    for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True):
        p, q = root(int(la[x])), root(int(lb[y]))
        if p != q and linked(np.frombuffer(a[x]["set"], np.uint64), np.frombuffer(other[y]["set"], np.uint64), percent):
            top[max(p, q)] = min(p, q)
            found.append((a[x]["id"], other[y]["id"]))
    return found


def _family_links(buckets: DataFrame, nodes: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components within the families of open buckets."""
    least = buckets.groupBy(F.col("band").alias("h_band")).agg(F.min("id").alias("u"))
    met = buckets.join(least, F.col("band") == F.col("h_band")).where("u < id").select("u", F.col("id").alias("v"))
    family = components(met).select(F.col("id").alias("f_id"), F.col("label").alias("family"))
    members = buckets.select("id", "label").distinct().join(family, F.col("id") == F.col("f_id")).select("id", "label", "family")
    members = cut(members.join(nodes.select(F.col("id").alias("n_id"), "n", "registers"), F.col("id") == F.col("n_id")).drop("n_id"))
    weight = F.sum(F.greatest("n", F.lit(LEAST_SHINGLES)))
    by_label = members.groupBy("family", "label").agg(weight.alias("w"))
    large = by_label.where(F.col("w") >= BLOCK_SHINGLES).select(F.col("label").alias("own"), F.ceil(F.col("w") / BLOCK_SHINGLES).alias("n_own"))
    small = by_label.where(F.col("w") < BLOCK_SHINGLES).groupBy(F.col("family").alias("s_family")).agg(F.ceil(F.sum("w") / BLOCK_SHINGLES).alias("n_shared"))
    placed = members.join(large, F.col("label") == F.col("own"), "left").join(small, F.col("family") == F.col("s_family"), "left")
    # blocks of large components count from 0, shared ones of the family down from -1
    number = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("id"), F.col("n_own"))).otherwise(-1 - F.pmod(F.xxhash64("label"), F.col("n_shared")))
    placed = cut(placed.select("id", "label", "n", "registers", F.struct("family", "own", number.alias("number")).alias("block")))
    full = placed.join(stored.select(F.col("id").alias("s_id"), "set"), F.col("id") == F.col("s_id"))
    blocks = cut(full.groupBy("block").agg(F.collect_list(F.struct("id", "label", "n", "registers", "set")).alias("items")))
    posted = buckets.select("band", F.col("id").alias("b_id")).join(placed.select("id", "block"), F.col("b_id") == F.col("id")).select("band", "block").distinct()
    a, b = (posted.select(F.col("band").alias(f"{x}_band"), F.col("block").alias(x)) for x in "ab")
    apart = F.col("a.own").isNull() | F.col("b.own").isNull() | (F.col("a.own") != F.col("b.own"))
    meet = a.join(b, (F.col("a_band") == F.col("b_band")) & (F.struct("a.own", "a.number") < F.struct("b.own", "b.number")) & apart).select("a", "b").distinct()
    a, b = (blocks.select(F.col("block").alias(f"{x}_key"), F.col("items").alias(f"{x}_items")) for x in "ab")
    pairs = meet.join(a, F.col("a") == F.col("a_key")).join(b, F.col("b") == F.col("b_key")).select("a_items", "b_items")
    alone = blocks.where("block.own is null").select(F.col("items").alias("a_items"), F.lit(None).cast(b.schema["b_items"].dataType).alias("b_items"))
    # a large family's pairs of blocks are dealt to all tasks
    todo = pairs.unionByName(alone).repartition(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = (batch.column(k)[at].as_py() for k in (0, 1))
                got = block_links(x, y, percent)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return todo.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    percent: int = 80,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when their sets of ``width``-word shingles have a Jaccard similarity of
    at least ``percent`` / 100; components are those of the links, named by their smallest id,
    whose row is kept. A null or blank text has no shingles and is linked with nothing. Ids
    are whole numbers; rows that repeat an id are one document, and if their texts differ the
    one whose set has the smallest hash stands for them; a row with a null id is linked with
    nothing, has a null component and is kept. Texts of any length are read whole. An empty
    table gives an empty result; other columns are ignored.
    """
    sig = cut(sketch(df, id_col, text_col, width))
    some = sig.where("n > 0 and id is not null")
    one = some.groupBy(F.col("id").alias("o_id")).agg(F.min(F.struct("s1", "s2")).alias("s"))
    reps = one.groupBy(F.col("s.s1").alias("r1"), F.col("s.s2").alias("r2")).agg(F.min("o_id").alias("rep"))
    reps = cut(one.join(reps, (F.col("s.s1") == F.col("r1")) & (F.col("s.s2") == F.col("r2"))).select("o_id", "rep", "r1", "r2"))
    nodes = some.join(reps.where("o_id = rep"), (F.col("id") == F.col("rep")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")))
    nodes = cut(nodes.select("id", "s1", "n", "bands", "registers").dropDuplicates(["id"]))

    posted = nodes.select("id", F.explode("bands").alias("band"), F.col("id").alias("label"))
    buckets = cut(_open_buckets(posted, None))
    light = nodes.select("id", "n", "registers")
    wanted = nodes.select(F.col("id").alias("w_id"), F.col("s1").alias("w_s1")).join(buckets.select(F.col("id").alias("b")).distinct(), F.col("w_id") == F.col("b"), "left_semi")
    stored = full_sets(df, buckets.select("id").distinct(), id_col, text_col, width, bits)
    stored = cut(stored.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("s1") == F.col("w_s1")), "left_semi").select("id", "set").dropDuplicates(["id"]))

    least = buckets.groupBy(F.col("band").alias("h_band")).agg(F.min("id").alias("u"))
    pairs = buckets.join(least, F.col("band") == F.col("h_band")).where("u < id").select("u", F.col("id").alias("v")).distinct()
    edges = cut(_confirmed(_likely(pairs, light, percent), stored, percent))
    labels = cut(components(edges))
    buckets = cut(_open_buckets(buckets, labels))
    if buckets.limit(1).count():
        more = cut(_family_links(buckets, light, stored, percent))
        if more.limit(1).count():
            labels = cut(components(edges.unionByName(more)))
    return _verdict(sig, reps, labels, id_col)


def _verdict(sig: DataFrame, reps: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    n = F.col("n").alias("n_shingles")
    lone = sig.where("n = 0 or id is null").select("id", n, F.col("id").alias("component_id"))
    some = sig.where("n > 0 and id is not null").join(reps.select("o_id", "rep"), F.col("id") == F.col("o_id")).select("id", n, "rep")
    known = labels.select(F.col("id").alias("l_id"), "label")
    some = some.join(known, F.col("rep") == F.col("l_id"), "left").select("id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    kept: Column = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return some.unionByName(lone).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for shingles of three words and 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), c AS (
  SELECT s, len(s) AS n, min(doc_id) AS c FROM d WHERE len(s) > 0 GROUP BY s
), t AS (
  SELECT c, n, unnest(s) AS word FROM c
), f AS (
  SELECT word, count(*) AS f FROM t GROUP BY word
), p AS (
  SELECT c, word FROM (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS k FROM t JOIN f USING (word)) WHERE k <= n - (85 * n + 99) // 100 + 1
), m AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.word = b.word AND a.c < b.c
), e AS (
  SELECT a, b FROM (SELECT m.a, m.b, x.n + y.n AS n, len(list_intersect(x.s, y.s)) AS shared FROM m JOIN c x ON x.c = m.a JOIN c y ON y.c = m.b) WHERE 100 * shared >= 85 * (n - shared)
), r(c, x) AS (
  SELECT c, c FROM c UNION SELECT r.c, z.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) z ON r.x = z.a
), label AS (
  SELECT c, min(x) AS label FROM r GROUP BY c
)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(label.label, d.doc_id) AS component_id, d.doc_id = coalesce(label.label, d.doc_id) AS kept
FROM d LEFT JOIN c ON c.s = d.s LEFT JOIN label ON label.c = c.c
"""
