"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, about the square root of half their
number. An index segment posts its vectors in the inverted file of each of these pivots,
with the pivot's place. A query reads the files of its own first pivots only and adds up,
for every vector met, how far each pivot's place is from its own: the footrule distance of
the two cut orders. The nearest share by footrule is then ranked by the true cosine. With so
many pivots in an order, a query reads half as many postings as there are vectors.

A vector's segment follows from its id and values, and the pivots from those of all vectors,
so results do not depend on how rows are dealt. A segment is built in one task, and queries
stream past it; rows, not pairs, are what moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import begin, quoted

#: Pivots, at most and as a share of the vectors: the sample that the index is fitted on.
PIVOTS, PIVOT_SHARE = 2048, 0.5
#: Share of a segment that is ranked by true cosine, and at least so many vectors.
SHARE = 0.25
LEAST = 256
#: Vectors of a segment, about, and queries that are taken at once.
SEGMENT, QUERIES = 4096, 256

#: Digits of approximate cosines; what agrees in them is a tie, which the smaller id wins.
TIE = 12


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite part, not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    sound = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(d, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each row's sums alike whatever stands around it."""
    dot = np.array([np.sum(x * y) for x, y in zip(a, b, strict=True)])
    sizes = [np.sqrt(np.array([np.sum(x * x) for x in m])) for m in (a, b)]
    return dot / (sizes[0] * sizes[1])


def pivots(vectors: DataFrame, n: int, of: int, seed: int = 7) -> np.ndarray:
    """At most ``n`` distinct vectors ``v`` of ``of``: those whose values have the smallest hash."""
    hashed = vectors.select("v", F.xxhash64(F.lit(seed), "v").alias("h"))
    limit = -(2**63) + min(int((2 * n + 50) / max(of, 1) * 2**64), 2**64 - 1)
    found = [r["v"] for r in hashed.where(F.col("h") <= limit).dropDuplicates(["h"]).orderBy("h").limit(n).collect()]
    if not found and of:
        # few distinct vectors, none of which has a small hash
        found = [r["v"] for r in hashed.orderBy("h").limit(1).collect()]
    return _unit(np.array(found, np.float64)) if found else np.zeros((0, 0))


def prefix_of(n_pivots: int) -> int:
    """Pivots in a cut order; a query then reads a posting for every second vector."""
    return max(int((n_pivots / 2) ** 0.5), 1)


def places(unit: np.ndarray, pivot: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its first pivots, nearest first; of equal ones the first in the list."""
    return np.argsort(-(unit @ pivot.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Segment:
    """Inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, pivot: np.ndarray, prefix: int):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.m, self.prefix = ids[by_id], m[by_id], prefix
        self.unit = _unit(self.m)
        order = np.concatenate([places(self.unit[i : i + 1024], pivot, prefix) for i in range(0, len(ids), 1024)])
        flat = order.ravel()
        at = np.argsort(flat, kind="stable")
        self.rows, self.place = at // prefix, (at % prefix).astype(np.int32)
        self.ends = np.searchsorted(flat[at], np.arange(len(pivot) + 1))

    def postings(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which postings a query reads, and the place of their pivot in the query's order."""
        start, n = self.ends[order], self.ends[order + 1] - self.ends[order]
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        return at, np.repeat(np.arange(len(order), dtype=np.int32), n)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of each vector's cut order to the query's; absent pivots stand at the cut."""
        k = self.prefix
        at, place = self.postings(order)
        # a pivot in one order only costs what it is short of the cut; one in both, the gap
        saved = 2 * (k - np.maximum(place, self.place[at]))
        return (k * (k + 1) - np.bincount(self.rows[at], saved, len(self.ids))).astype(np.uint16 if k < 255 else np.int64)

    def nearest(self, qid: int, q: np.ndarray, order: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and rows of the best ``k`` found, best first."""
        n = min(len(self.ids), max(int(share * len(self.ids)), least))
        # vectors are in order of id, so a stable sort keeps the smaller ids of a tie
        some = np.argsort(self.footrule(order), kind="stable")
        some = some[self.ids[some] != qid][:n]
        about = np.round(self.unit[some] @ q, TIE)
        best = some[np.lexsort((self.ids[some], -about))[:k]]
        return self.ids[best], best


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    n_pivots: int = PIVOTS,
    share: float = SHARE,
    least: int = LEAST,
    segment: int = SEGMENT,
) -> DataFrame:
    """Each query's nearest others: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Nearness is the cosine of the original vectors in double precision; ties go to the
    smaller id. A vector that is null, zero or holds a null or non-finite part takes no part,
    nor does one without an id or of another length than most (the commonest length). Rows
    that repeat an id are candidates each, but never of a query with that id. A query gets
    all candidates if they are fewer than ``k``; an empty table gives an empty result; other
    columns are ignored, whatever their names.

    Every vector is indexed; ``n_pivots`` vectors are the sample that the index is fitted on.
    """
    spark = df.sparkSession
    id_, vec = F.col(quoted(id_col)), F.col(quoted(vec_col))
    sound = df.where(usable(vec) & id_.isNotNull())
    sound = sound.select(id_.cast("bigint").alias("id"), vec.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    common = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = common["n"], common["count"]
    sound = sound.where(F.size("v") == dim)
    pivot = pivots(sound, min(n_pivots, max(int(n * PIVOT_SHARE), 1)), n)
    prefix, lanes = prefix_of(len(pivot)), -(-n // segment)
    shared = spark.sparkContext.broadcast(pivot)  # n_pivots vectors

    indexed = sound.select(F.pmod(F.xxhash64("id", "v"), F.lit(lanes)).alias("lane"), F.lit(0).alias("kind"), "id", "v")
    asked = sound.where("q").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))).alias("lane"), F.lit(1).alias("kind"), "id", "v")
    # lanes are few where they are spread over more tasks than there are lanes
    rows = indexed.unionByName(asked).repartition(4 * lanes if lanes <= 256 else lanes, "lane").sortWithinPartitions("lane", "kind", "id", "v")

    def answers(seg: Segment, ids: np.ndarray, m: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
        qs, vs, scores = [], [], []
        unit = _unit(m)
        for qid, q, u, order in zip(ids.tolist(), m, unit, places(unit, pivot, prefix), strict=True):
            found, where = seg.nearest(qid, u, order, k, share, least)
            qs += [qid] * len(found)
            vs += found.tolist()
            scores += cosine(np.broadcast_to(q, (len(where), dim)), seg.m[where]).tolist()
        return pa.RecordBatch.from_pydict({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(vs, pa.int64()), "score": pa.array(scores, pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        pivot, lane, ids, vectors, seg = shared.value, None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = b.slice(start, end - start)
                if key[start] // 2 != lane:
                    lane, ids, vectors, seg = key[start] // 2, [], [], None
                i, m = part.column(2).to_numpy(), _matrix(part.column(3), dim)
                if key[start] % 2 == 0:
                    i, m = _few_copies(i, m, k)
                    ids.append(i)
                    vectors.append(m)
                elif ids:
                    if seg is None:
                        seg = Segment(*_few_copies(np.concatenate(ids), np.concatenate(vectors), k), pivot, prefix)
                        ids, vectors = ids[:1], []
                    for at in range(0, len(i), QUERIES):
                        yield answers(seg, i[at : at + QUERIES], m[at : at + QUERIES], pivot)

    found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _few_copies(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of id and values without more than ``k`` equal ones: no answer has more."""
    if len(ids) <= k:
        return ids, m
    keep = np.ones(len(ids), bool)
    keep[k:] = (ids[k:] != ids[:-k]) | (m[k:] != m[:-k]).any(axis=1)
    return ids[keep], m[keep]


def op6_permutation_index(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 nearest vectors of every fiftieth one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)
