"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first pass keeps a fixed-size signature of each row (length and hash of the first
characters of its normalised text). Keys that only one row has end there. Repeated keys go
into a filter of fixed size, and the second pass hashes the full content of rows that the
filter lets through, and of no others. The filter errs only towards hashing too much. Text
is never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BLANKS, bitmap, cut, mark, quoted, slot

#: Least and most bits of a filter: 2 MB to 128 MB to broadcast. Repeated keys that the most
#: cannot tell apart make the second pass hash more rows than it needs, and change no result.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30
#: Bits for each row.
BITS_A_ROW = 8
#: Groups of more than this share of all rows are joined by a broadcast: one row for each.
HOT = 1000


def squeezed(text: Column) -> Column:
    """Text without ASCII white space; a null is empty.

    Six plain replacements run about twice as fast as translate() or a regular expression.
    """
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    head: int = 64,
    bits: int | None = None,
    digest: str | None = None,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when they agree after deleting ASCII white space; a null is an empty
    text, so all nulls and blank texts are one group. The row with the most code points
    stays, then the smallest id (a null id comes last). Rows that repeat an id and its text
    count in ``group_size`` and share one verdict. An empty table gives an empty result.
    ``digest`` names a column to add with every row's own hash of the normalised text; other
    columns are ignored, so their names cannot clash.

    head: characters in the prefix hash. bits: size of the two filters, which otherwise
    follows the number of rows. Texts of any length are hashed whole.
    """
    carry = [digest] if digest else []
    norm = squeezed(F.col("__text"))
    rows = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    n = rows.count()
    bits = bits or min(max(1 << (BITS_A_ROW * n).bit_length(), LEAST_BITS), MOST_BITS)

    by_length = slot(bits, F.char_length("__norm"))
    by_prefix = slot(bits, F.char_length("__norm"), F.substring("__norm", 1, head))
    sig = cut(rows.select(norm.alias("__norm")).select(by_length.alias("l"), by_prefix.alias("p")))
    lengths = bitmap(sig, "l", repeated=True)
    prefixes = cut(bitmap(mark(sig, F.col("l"), lengths, "many").where("many"), "p", repeated=True))

    slim = rows.select("__id", norm.alias("__norm"), F.coalesce(F.char_length("__text"), F.lit(0)).alias("__chars"))
    met = mark(slim, by_prefix, prefixes, "many")
    full = F.when(F.col("many"), F.sha2(F.col("__norm"), 256))
    rows = cut(met.select("__id", "__chars", full.alias("__full"), *[F.sha2(F.col("__norm"), 256).alias(c) for c in carry]))

    order = F.struct((-F.col("__chars")).alias("c"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"))
    groups = rows.where("__full is not null").groupBy(F.col("__full").alias("__g")).agg(F.min(order).alias("__best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    alone = rows.where("__full is null").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), *carry)
    groups = cut(groups)
    # fewer than HOT groups have more than that share of the rows
    hot = groups.where(F.col("group_size") > n / HOT)
    hashed = rows.where("__full is not null")
    of_hot = hashed.join(F.broadcast(hot), F.col("__full") == F.col("__g"))
    others = hashed.join(F.broadcast(hot), F.col("__full") == F.col("__g"), "left_anti")
    found = of_hot.unionByName(others.join(groups, F.col("__full") == F.col("__g"), "left"))
    found = found.select("__id", F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("__best.i")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), *carry)
    both = found.unionByName(alone)
    return both.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, digest="text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
