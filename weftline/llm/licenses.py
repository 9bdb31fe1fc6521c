"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are one-line notices, standard headers, whole short licences and the openings of
long ones. A unit is a line of a file, a paragraph of several lines, the first words of the
file, as many as an opening or a short licence has, and the whole text of a licence file.
Units and templates are sparse TF-IDF vectors. Document frequencies of all terms are counted
over all files and joined to the terms of the scored units only. By Cauchy-Schwarz a unit
cannot reach the threshold unless it has some of a template's terms that weigh enough
together; of those, the rarest are its anchors. Nor can it if the terms that no template has
make up too much of its own length. That length is first bounded from below, with the exact
weights of the commonest terms and the least weight of all others, where a unit is read and
without a shuffle of its terms; units that pass are read again and scored exactly.
An SPDX tag states its licence itself.

A file without a licence of its own takes that of the nearest directory above it (its own
directory first) that holds a licence file. Directories, not files, are joined with their
ancestors. Everything on rows is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Kept, bitmap, cut, fresh, mark, quoted, slot
from weftline.llm.license_texts import HEADERS, NOTICES, OPENINGS, TEXTS

#: By SPDX name; of equal cosines the first one counts.
TEMPLATES = NOTICES + HEADERS + TEXTS + OPENINGS
#: Cosine from which a unit carries a template's licence.
THRESHOLD = 0.75
#: Names of licence files.
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)(\.[a-z0-9]+)?$"

#: A tag that names the licence of its file.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"

BREAK = "[^a-z0-9]+"
#: Lines without a letter or digit of ASCII part paragraphs.
GAP = r"\n(?:[^A-Za-z0-9\n]*\n)+"
#: Words of a file's head, once for openings and once for short licences.
HEADS = (120, 240)
#: Terms of scored units up to which their weights are broadcast; beyond it the join shuffles.
FEW_TERMS = 200_000
#: Commonest terms whose exact weights bound the lengths of units; they are broadcast.
COMMON = 1 << 16
#: Bits of the filters that tell which files, units and terms are needed for exact scores.
BITS = 1 << 24


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def template_terms(text: str) -> Counter:
    return Counter(t for t in re.split(BREAK, text.lower()) if t)


def idf(n_files: int, with_term: int) -> float:
    return math.log((1 + n_files) / (1 + with_term)) + 1


def template_vectors(templates: tuple[tuple[str, str], ...], weights: dict[str, float]) -> list[dict[str, float]]:
    out = []
    for _, text in templates:
        v = {t: n * weights[t] for t, n in template_terms(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out


def anchors(vectors: list[dict[str, float]], threshold: float, seen: dict[str, int]) -> list[str]:
    """Terms one of which a unit must have: the others of a template weigh too little.

    ``seen`` tells how many files hold a term; the commonest are left out first.
    """
    out = set()
    for v in vectors:
        others = 0.0
        for t in sorted(v, key=lambda t: (-seen.get(t, 0), t)):
            others += v[t] ** 2
            if others >= threshold**2 * (1 - 1e-9):
                out.add(t)
    return sorted(out)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _units(files: DataFrame) -> DataFrame:
    """path, unit and terms of what is compared with the templates."""
    text, path = F.col("text"), F.col("path")
    several = text.contains("\n")
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("no", "part"), text, F.lit("line").alias("kind"))
    parts = files.where(several).select(path, F.posexplode(F.split(text, GAP)).alias("no", "part"), text, F.lit("part").alias("kind")).where(F.col("part").contains("\n"))
    cuts = lines.unionByName(parts).select(path, F.xxhash64("kind", "no", "text").alias("unit"), terms(F.col("part")).alias("terms"))
    words = files.where(several).select(path, text, terms(text).alias("terms"))
    heads = words.select(path, F.explode(F.array(*map(F.lit, HEADS))).alias("n"), "terms", text)
    heads = heads.select(path, F.xxhash64(F.lit("head"), "n", "text").alias("unit"), F.expr("slice(terms, 1, n)").alias("terms"))
    whole = files.where(path.rlike(LICENSE_FILE)).select(path, F.xxhash64(F.lit("whole"), "text").alias("unit"), terms(text).alias("terms"))
    return cuts.unionByName(heads).unionByName(whole)


def _tallies(words: Column) -> Column:
    """Each distinct one of ``words`` (one at least) as term and tf, in the row itself."""

    # an array of one binds a value, so that it is found once
    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(first), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(words)), runs), F.lit(0))


def _least_common(counts: DataFrame, most: int) -> int:
    """A number of files that at most ``most`` terms reach."""
    level = F.floor(F.log2("n") * 8).alias("level")
    # at most a few hundred rows
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("terms"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    levels.sort(key=lambda r: -r["level"])
    least, terms_ = levels[0]["high"] + 1 if levels else 1, 0
    for r in levels:
        terms_ += r["terms"]
        if terms_ > most:
            break
        least = r["low"]
    else:
        least = 1
    return least


def _may_reach(units: DataFrame, counts: DataFrame, n: int, weights: dict[str, float], vectors: list[dict[str, float]], threshold: float) -> DataFrame:
    """path and unit of those whose terms of templates weigh enough in a length not above their own.

    A template's vector is of length one and has no other terms, so its product with a unit's is
    at most the length of the unit's part in the templates' terms. Nor is it more than the sum of
    that part with the most that each term has in any template, which is less for long texts.
    """
    most: dict[str, float] = {}
    for v in vectors:
        for t, x in v.items():
            most[t] = max(x, most.get(t, 0.0))
    least = _least_common(counts, COMMON)
    others = counts.where((F.col("n") >= least) & ~F.col("term").isin(list(weights)))
    others = others.select(F.col("term").alias("b_term"), (F.log((1 + n) / (1 + F.col("n"))) + 1).alias("b_weight"), F.lit(None).cast("double").alias("most"))
    known = units.sparkSession.createDataFrame([(t, x, most[t]) for t, x in weights.items()], "b_term string, b_weight double, most double")
    rows = units.select("path", "unit", F.inline(_tallies(F.col("terms"))))
    rows = rows.join(F.broadcast(others.unionByName(known)), F.col("term") == F.col("b_term"), "left")
    w = F.col("tf") * F.coalesce("b_weight", F.lit(idf(n, least - 1)))
    sums = rows.groupBy("path", "unit").agg(F.sum(F.when(F.col("most").isNotNull(), w * w)).alias("part"), F.sum(w * F.col("most")).alias("dot"), F.sum(w * w).alias("whole"))
    # cosines are rounded to nine digits
    enough = max(0.0, threshold - 1e-9) ** 2 * (1 - 1e-9)
    return sums.where(F.least("part", F.col("dot") * F.col("dot")) >= F.col("whole") * enough).select("path", "unit")


def _those_in(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """Rows of ``df`` whose ``cols`` ``keys`` has too, and the few that a filter takes for such."""
    (flag,) = fresh(df, "in")
    filt = bitmap(keys.select(slot(BITS, *map(F.col, cols)).alias("at")), "at")
    return mark(df, slot(BITS, *map(F.col, cols)), filt, flag).where(F.col(flag)).drop(flag)


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """path, license, score of the files (path, text) in which a unit reaches the threshold."""
    vocab = sorted({t for _, text in templates for t in template_terms(text)})
    met = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    n = files.count()
    kept = Kept(met.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    counts = kept.df
    # at most one row for each template term
    seen = {r["term"]: r["n"] for r in counts.where(F.col("term").isin(vocab)).collect()}
    weights = {t: idf(n, seen.get(t, 0)) for t in vocab}
    vectors = template_vectors(templates, weights)
    heavy = anchors(vectors, threshold, seen)

    spark = files.sparkSession
    by_term = [(t, i, x) for i, v in enumerate(vectors) for t, x in v.items()]
    table = F.broadcast(spark.createDataFrame(by_term, "t_term string, template int, t_weight double"))

    anchored = _units(files).where(F.arrays_overlap("terms", _array(heavy)))
    near = cut(_may_reach(anchored, counts, n, weights, vectors, threshold))
    units = _those_in(_units(_those_in(files, near, "path")), near, "path", "unit")
    tf = cut(units.select("path", "unit", F.explode("terms").alias("term")).groupBy("path", "unit", "term").agg(F.count(F.lit(1)).alias("tf")))
    weight = cut(_those_in(counts, tf, "term").select(F.col("term").alias("w_term"), (F.log((1 + n) / (1 + F.col("n"))) + 1).alias("weight")))
    few = weight.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    w = cut(tf.join(F.broadcast(weight) if few else weight, F.col("term") == F.col("w_term")).select("path", "unit", "term", (F.col("tf") * F.col("weight")).alias("w")))
    kept.drop()
    norms = w.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")).select(F.col("path").alias("n_path"), F.col("unit").alias("n_unit"), "size")
    dots = w.join(table, F.col("term") == F.col("t_term")).groupBy("path", "unit", "template").agg(F.sum(F.col("w") * F.col("t_weight")).alias("dot"))
    scored = dots.join(norms, (F.col("path") == F.col("n_path")) & (F.col("unit") == F.col("n_unit")))
    # sums of floats depend on their order in the last digits; ties should not
    scored = scored.select("path", "template", F.round(F.col("dot") / F.col("size"), 9).alias("score")).where(F.col("score") >= threshold)
    names = _array([name for name, _ in templates])
    scored = scored.select("path", "score", (-F.col("template")).alias("t"), F.get(names, F.col("template")).alias("license"))
    # the first tag of a file; it goes before a template of the same cosine
    tags = files.where(F.col("text").contains("SPDX-License-Identifier:")).select("path", F.lit(1.0).alias("score"), F.lit(1).alias("t"), F.regexp_extract("text", SPDX, 1).alias("license")).where("license <> ''")
    best = scored.unionByName(tags).groupBy("path").agg(F.max(F.struct("score", "t", "license")).alias("b"))
    return best.select("path", "b.license", "b.score")


def directory(path: Column) -> Column:
    """The part of a path before its last slash; the root is empty, that of a null is null."""
    inner = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    return F.when(path.isNotNull(), inner)


def nearest(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """dir, license, from_path for each of ``directories`` under one of ``licensed``."""
    parts = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above"), k.alias("depth")))
    pairs = directories.select("dir", F.inline(levels))
    met = pairs.join(licensed.select(F.col("dir").alias("l_dir"), "license", "from_path"), F.col("above") == F.col("l_dir"))
    best = met.groupBy("dir").agg(F.max(F.struct("depth", "license", "from_path")).alias("b"))
    return best.select(F.col("dir").alias("b_dir"), F.col("b.license").alias("near"), F.col("b.from_path").alias("near_path"))


def license_scan(df: DataFrame, path_col: str = "path", text_col: str = "text", *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: path, ``license``, ``score``, ``basis``, ``from_path``.

    ``basis`` is "own", "inherited" or null where no licence is known; ``from_path`` is the
    file that says so, ``score`` its cosine if it is the file itself. Of several licences in
    a file the one with the highest cosine counts, then a tag, then the first template; of
    several licence files in a directory the one with the highest cosine, then the smallest
    path. Whole texts of any length are read. A null text has no
    licence of its own; a null path stands alone in no directory: it has none at all. Rows
    that repeat a path are one file: a licence in any of their texts is that of all. An
    empty table gives an empty result; other columns are ignored.
    """
    files = df.select(F.col(quoted(path_col)).cast("string").alias("path"), F.col(quoted(text_col)).alias("text"))
    own = cut(own_licenses(files.where("path is not null"), templates, threshold))
    of_file = own.where(F.col("path").rlike(LICENSE_FILE))
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("from_path"), "license"))
    licensed = of_file.groupBy(directory(F.col("path")).alias("dir")).agg(first.alias("b")).select("dir", "b.license", "b.from_path")
    paths = files.select("path")
    near = nearest(paths.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct(), licensed)
    said = own.select(F.col("path").alias("o_path"), "license", "score")
    out = paths.join(said, F.col("path") == F.col("o_path"), "left").withColumn("dir", directory(F.col("path")))
    out = out.join(near, F.col("dir") == F.col("b_dir"), "left")
    basis = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited")
    source = F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("near_path"))
    return out.select(F.col("path").alias(path_col), F.coalesce("license", "near").alias("license"), "score", basis.alias("basis"), source.alias("from_path"))


def document_path() -> Column:
    """Documents stand in folders of 1000 of their source, and in those by 200.

    Every tenth one is a licence file of the upper folder.
    """
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 200), F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/f"), F.floor(F.col("doc_id") / 1000), F.lit("/"), name)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its path, and what the scan says of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("path", document_path())
    out = license_scan(docs)
    doc_id = F.regexp_extract("path", r"(-?[0-9]+)(\.txt)?$", 1).try_cast("bigint")
    return out.select(doc_id.alias("doc_id"), "path", "license", "score", "basis", "from_path")


def op7_sql() -> str:
    """The same in SQL, with the templates as a table."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    toks = "list_filter(regexp_split_to_array(lower({}), '" + BREAK + "'), lambda x: x <> '')"
    return rf"""
WITH files AS (
  SELECT doc_id, coalesce(source, 'none') || '/f' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || CAST(doc_id AS VARCHAR) ELSE 'd' || CAST(doc_id // 200 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path, text FROM documents
), templates(t, license, text) AS (VALUES {rows}),
df AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({toks.format("coalesce(text, '')")})) AS term FROM files) GROUP BY term
), total AS (
  SELECT count(*) AS n FROM files
), units AS (
  SELECT path, 'line' AS kind, unnest(range(len(string_split(text, chr(10))))) AS no, {toks.format("unnest(string_split(text, chr(10)))")} AS terms FROM files WHERE text IS NOT NULL
  UNION ALL
  SELECT path, 'part', no, {toks.format("part")} FROM (SELECT path, unnest(range(len(regexp_split_to_array(text, '{GAP}')))) AS no, unnest(regexp_split_to_array(text, '{GAP}')) AS part FROM files WHERE contains(text, chr(10))) WHERE contains(part, chr(10))
  UNION ALL
  SELECT path, 'head', n, {toks.format("text")}[1:n] FROM files, (VALUES ({HEADS[0]}), ({HEADS[1]})) h(n) WHERE contains(text, chr(10))
  UNION ALL
  SELECT path, 'whole', 0, {toks.format("text")} FROM files WHERE text IS NOT NULL AND regexp_matches(path, '{LICENSE_FILE}')
), tf AS (
  SELECT path, kind, no, term, count(*) AS tf FROM (SELECT path, kind, no, unnest(terms) AS term FROM units) GROUP BY ALL
), w AS (
  SELECT path, kind, no, term, tf * (ln((1 + total.n) / (1 + df.n)) + 1) AS w FROM tf JOIN df USING (term), total
), size AS (
  SELECT path, kind, no, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL
), tt AS (
  SELECT t, term, count(*) AS tf FROM (SELECT t, unnest({toks.format("text")}) AS term FROM templates) GROUP BY ALL
), tw AS (
  SELECT t, tt.term, tf * (ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1) AS w FROM tt LEFT JOIN df ON df.term = tt.term, total
), ts AS (
  SELECT t, sqrt(sum(w * w)) AS size FROM tw GROUP BY t
), scored AS (
  SELECT w.path, tw.t, round(sum(w.w * tw.w) / any_value(size.size) / any_value(ts.size), 9) AS score
  FROM w JOIN tw USING (term) JOIN size ON size.path = w.path AND size.kind = w.kind AND size.no = w.no JOIN ts ON ts.t = tw.t
  GROUP BY w.path, w.kind, w.no, tw.t
), found AS (
  SELECT path, score, -t AS turn, license FROM scored JOIN templates USING (t) WHERE score >= {THRESHOLD}
  UNION ALL
  SELECT path, 1.0, 1, regexp_extract(text, '{SPDX}', 1) FROM files WHERE regexp_extract(text, '{SPDX}', 1) <> ''
), own AS (
  SELECT path, max((score, turn, license)) AS b FROM found GROUP BY path
), dirs AS (
  SELECT dir, min((-score, path, license)) AS b FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, b[1] AS score, b[3] AS license FROM own WHERE regexp_matches(path, '{LICENSE_FILE}')) GROUP BY dir
), near AS (
  SELECT f.path, max((length(dirs.dir), dirs.b[3], dirs.b[2])) AS b FROM files f JOIN dirs ON starts_with(f.path, dirs.dir || '/') GROUP BY f.path
)
SELECT f.doc_id, f.path, coalesce(own.b[3], near.b[2]) AS license, own.b[1] AS score, CASE WHEN own.path IS NOT NULL THEN 'own' WHEN near.path IS NOT NULL THEN 'inherited' END AS basis, CASE WHEN own.path IS NOT NULL THEN f.path ELSE near.b[3] END AS from_path
FROM files f LEFT JOIN own ON own.path = f.path LEFT JOIN near ON near.path = f.path
"""
