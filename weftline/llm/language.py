"""Language ID by bit-sliced Bloom filters of byte n-grams.

One table of words holds a filter for each language in its bits: looking up an n-gram's
positions and joining the words by AND gives all languages that have it at once. A text's
hits are counted for each language, corrected for the share of hits that the filter's fill
gives by chance, and the largest count decides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import by_batch, quoted, texts

#: Bytes of an n-gram; texts are in lower case, what is no letter in ASCII is a space.
GRAM = 4
#: Positions of the table, a power of two, and positions of one n-gram.
POSITIONS = 1 << 20
HASHES = 2
#: A language has an n-gram if it is so frequent there, ...
LEAST_SHARE = 2e-6
#: ... and at least so frequent compared with the language where it is most frequent.
LEAST_RATIO = 0.1
#: The sample to learn from: so many texts of a language, of so many bytes, of so many languages.
SAMPLE_ROWS, SAMPLE_BYTES, LANGUAGES = 2000, 1 << 24, 256
#: Texts are counted so many bytes at a time.
BLOCK = 1 << 20

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Fixed odd multipliers of the hash functions.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def normal(text: str) -> bytes:
    """Bytes to take n-grams of; never fewer than one n-gram has."""
    return b"  " + text.lower().encode("utf-8", "replace").translate(SPACED) + b"  "


def grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = max(len(b) - GRAM + 1, 0)
    out = np.zeros(n, np.uint32)
    for i in range(GRAM):
        out |= b[i : i + n] << np.uint32(8 * i)
    return out


def positions(g: np.ndarray, size: int) -> list[np.ndarray]:
    shift = np.uint32(32 - size.bit_length() + 1)
    return [((g ^ (g >> np.uint32(15))) * np.uint32(m)) >> shift for m in MULTIPLIERS[:HASHES]]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (words of 64 languages, positions) of masks
    by_chance: np.ndarray  # for each language, the share of strange n-grams that it seems to have

    def counts(self, data: bytes) -> tuple[np.ndarray, int]:
        """Hits of each language in one normalised text, and its n-grams."""
        hits, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(data), BLOCK):
            g = grams(data[at : at + BLOCK + GRAM - 1])
            total += len(g)
            hits += self.hits(g, np.array([0]))[0] if len(g) else 0
        return hits, total

    def hits(self, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hits in each segment of n-grams, by language."""
        at = positions(g, self.table.shape[1])
        out = np.zeros((len(starts), len(self.languages)))
        for w, row in enumerate(self.table):
            mask = row[at[0]]
            for p in at[1:]:
                mask &= row[p]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] = np.add.reduceat(((mask >> row.dtype.type(i - 64 * w)) & row.dtype.type(1)).astype(np.int32), starts)
        return out

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and coverage of each text."""
        own = np.maximum((hits - n[:, None] * self.by_chance) / (1 - self.by_chance), 0)
        total = own.sum(axis=1)
        best = own.argmax(axis=1)
        top = own[np.arange(len(own)), best]
        return best, top / np.maximum(total, 1e-9), top / np.maximum(n, 1)

    def predict(self, batch: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and coverage: the shares of the best in all hits and in all n-grams."""
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(batch)
        if not self.languages:
            return out
        some: list[tuple[int, bytes]] = []

        def flush() -> None:
            if not some:
                return
            if len(some) == 1:
                h, n = self.counts(some[0][1])
                hits, n = h[None], np.array([n])
            else:
                data = b"".join(x for _, x in some)
                n = np.array([len(x) for _, x in some])
                # n-grams that reach into the next text are segments of their own, left out
                ends = np.cumsum(n)
                cuts = np.column_stack([ends - n, ends - GRAM + 1]).ravel()
                hits = self.hits(grams(data + b" " * GRAM), cuts)[::2]
                n = n - GRAM + 1
            for (i, _), b, s, c in zip(some, *(x.tolist() for x in self.decide(hits, n)), strict=True):
                out[i] = (self.languages[b], min(s, 1.0), min(c, 1.0))
            some.clear()

        held = 0
        for i, t in enumerate(batch):
            if not LETTER.search(t):
                continue
            data = normal(t)
            if held and held + len(data) > BLOCK:
                flush()
                held = 0
            some.append((i, data))
            held += len(data)
        flush()
        return out


def fit_texts(labelled: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs."""
    languages = tuple(sorted({x for x, _ in labelled}))
    seen = {}
    for lang in languages:
        parts = [np.unique(grams(normal(t)), return_counts=True) for x, t in labelled if x == lang and t]
        if not parts:
            continue
        g, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([p[1] for p in parts]))
        seen[lang] = (g, counts / counts.sum())
    every = np.unique(np.concatenate([g for g, _ in seen.values()])) if seen else np.zeros(0, np.uint32)
    top = np.zeros(len(every))
    for g, share in seen.values():
        i = np.searchsorted(every, g)
        top[i] = np.maximum(top[i], share)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((-(-len(languages) // 64), POSITIONS), kind)
    fill = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        if lang in seen:
            g, share = seen[lang]
            g = g[(share >= LEAST_SHARE) & (share >= LEAST_RATIO * top[np.searchsorted(every, g)])]
            row = table[i // 64]
            for p in positions(g, POSITIONS):
                row[p] |= kind(1 << i % 64)
            fill[i] = np.mean((row >> kind(i % 64)) & kind(1))
    return Model(languages, table, fill**HASHES)


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """Labelled whole texts of the commonest ``languages``, the same ones each time.

    Of each language at most ``rows`` texts and ``size`` bytes (one text at least): those with
    the smallest hash of id and text, repeated rows once. The hash of the last one is found
    on numbers alone, so that only texts that are taken leave the tasks.
    """
    labelled = df.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(lang_col)).cast("string").alias("l"), F.col(quoted(text_col)).alias("t")).where("l is not null and t is not null")
    hashed = labelled.withColumn("h", F.xxhash64("i", "t"))
    known = {r["l"]: (r["n"], r["h"]) for r in hashed.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).orderBy(F.desc("n"), "l").limit(languages).collect()}

    def up_to(last: dict[str, int]) -> DataFrame:
        limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
        return hashed.where(F.col("h") <= F.try_element_at(limit, F.col("l")))

    if not known:
        return []
    # half as many again as are wanted, so that chance leaves enough
    near = up_to({k: max(least, -(2**63) + min(int((1.5 * rows + 50) / n * 2**64), 2**64 - 1)) for k, (n, least) in known.items()})
    last, held = {}, Counter()
    for r in near.select("l", "h", F.octet_length("t").alias("n")).distinct().orderBy("h").collect():
        held[r["l"], "rows"] += 1
        held[r["l"], "bytes"] += r["n"]
        if held[r["l"], "rows"] == 1 or held[r["l"], "rows"] <= rows and held[r["l"], "bytes"] <= size:
            last[r["l"]] = r["h"]
        else:
            held[r["l"], "bytes"] += size  # full
    return [(r["l"], r["t"]) for r in up_to(last).dropDuplicates(["l", "h"]).orderBy("l", "h").select("l", "t").toLocalIterator()]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    return fit_texts(sample(df, id_col, text_col, lang_col, rows))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score``, ``coverage`` and columns to keep.

    ``und`` with score 0 where a text is null or has no letter, and for every text if the
    model has no language. Ties go to the language first in order. Repeated rows are each
    judged, whole texts are read whatever their length, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_, keep = F.col(quoted(id_col)), [F.col(quoted(c)) for c in keep]
    schema = df.select(id_, *keep).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.predict(texts(batch.column(0)))
        made = [pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*names, "lang_pred", "score", "coverage"])

    names = list(schema.names)
    out = schema.add("lang_pred", "string").add("score", "double").add("coverage", "double")
    return df.select(F.col(quoted(text_col)).alias("__text"), id_, *keep).mapInArrow(by_batch(run), out)


def known_only(df: DataFrame, model: Model, least_coverage: float, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language that knows at least that share of its n-grams.

    Rows pass with all their columns; null, blank and foreign texts go.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.predict(texts(batch.column(at)))
        return batch.filter(pa.array([x != UNKNOWN and c >= least_coverage for x, _, c in got], pa.bool_()))

    return df.mapInArrow(by_batch(run), df.schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def op9_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of documents, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
