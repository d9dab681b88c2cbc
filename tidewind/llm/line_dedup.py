"""Removal of boilerplate lines that spread over many sites.

For each line hash, a HyperLogLog sketch of its sites is merged by aggregation. A line is boilerplate if it stands on min_sites sites at
least. Lines whose estimate is so near to the threshold that the sketch can't decide get exact distinct counts. Every occurrence of a
boilerplate line goes.

Lines are compared by two independent 64-bit hashes. The thin table of lines (identifier, site, hashes) is written once; texts are read
for it and for the removal. Up to FILTER_LINES boilerplate lines are a filter in the plan, so that no text is shuffled; more are joined.

Defined results: null text gives null text and no lines; a line is what stands between line feeds, compared after trimming white space;
empty lines are never boilerplate; a null site counts as one site of its own; repeated rows add no sites; an empty table gives an
empty result; other columns are passed on, whatever their names, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, columns, fresh, hinted, quoted, shared_dir, table, written

#: Registers: 2**12, a relative standard error of 1.04 / 2**6 = 1.6 %.
LOG_K = 12
#: Standard errors on each side of a threshold within which counts are made exactly.
BAND = 6
#: Up to so many lines near the threshold are sent to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Up to so many boilerplate lines are literals of a filter.
FILTER_LINES = 5_000
#: The second hash is of the line after this.
SALT = "\u0001"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def line_hash(line: Column) -> Column:
    """The two hashes of a line."""
    return F.struct(F.xxhash64(trimmed(line)).alias("h"), F.xxhash64(F.lit(SALT), trimmed(line)).alias("g"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, site (hash), h and g (hashes of the line), for each line that isn't empty."""
    site = F.coalesce(F.xxhash64("site"), F.lit(0).cast("long"))
    hashes = F.filter(F.transform(F.split("text", "\n", -1), trimmed), lambda x: x != "")
    hashes = F.transform(hashes, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(SALT), x).alias("g")))
    return docs.where("text IS NOT NULL").select("doc_id", site.alias("site"), F.inline(hashes))


def spread_lines(lines: DataFrame, min_sites: int, folder: str, name: str) -> DataFrame:
    """h, g of the lines that stand on so many sites at least, from the rows of line_table."""
    spread = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sites")).where(F.col("n") >= min_sites)
    spread = spread.select("h", "g", F.hll_sketch_estimate("sites").alias("sites"))
    error = BAND * 1.04 / math.sqrt(2**LOG_K)
    spread = written(spread.where(F.col("sites") >= min_sites / (1 + error)), f"{name}_spread", folder)
    sure = F.col("sites") > min_sites / (1 - error)
    near = hinted(spread.where(~sure).select("h", "g"), BROADCAST_LINES)
    # distinct pairs first, so that a line that is everywhere is counted by many tasks
    exact = lines.join(near, ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_sites"))
    return written(spread.where(sure).select("h", "g").unionByName(exact.where(F.col("n_sites") >= min_sites).select("h", "g")), name, folder)


def boilerplate(docs: DataFrame, min_sites: int, folder: str) -> DataFrame:
    """The hashes of boilerplate lines of docs (doc_id, text, site)."""
    return spread_lines(written(line_table(docs), "lines", folder), min_sites, folder, "found")


def without_lines(docs: DataFrame, flagged: DataFrame, text_col: str, id_col: str, filter_lines: int = FILTER_LINES) -> tuple[DataFrame, Column, Column]:
    """docs, all lines of a text and those of them that stay; docs may have got columns for that."""
    all_lines = F.split(F.col(quoted(text_col)), "\n", -1)
    if flagged.count() <= filter_lines:
        pairs = sorted((r.h, r.g) for r in flagged.collect())  # FILTER_LINES at most
        if not pairs:
            return docs, all_lines, all_lines
        first = ", ".join(f"{h}L" if h > -(2**63) else "CAST(-9223372036854775808 AS BIGINT)" for h, _ in pairs)
        second = ", ".join(f"{g}L" if g > -(2**63) else "CAST(-9223372036854775808 AS BIGINT)" for _, g in pairs)
        (name,) = fresh(docs.columns, "lines")
        docs = docs.withColumn(name, all_lines)
        spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
        # a line of which either hash is none of the flagged ones stays
        kept = F.expr(f"filter({quoted(name)}, x -> xxhash64(trim(BOTH ({spaces}) FROM x)) NOT IN ({first}) OR xxhash64('{SALT}', trim(BOTH ({spaces}) FROM x)) NOT IN ({second}))")
        return docs, F.col(quoted(name)), kept
    own = columns(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL")
    own = own.select("doc_id", F.inline(F.transform(F.split("text", "\n", -1), line_hash))).distinct()
    gone_name, id_name = fresh(docs.columns, "gone", "id")
    gone = own.join(hinted(flagged, BROADCAST_LINES), ["h", "g"], "left_semi").groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_set(F.struct("h", "g")).alias(gone_name))
    docs = docs.join(gone, F.col(quoted(id_col)).eqNullSafe(F.col(quoted(id_name))), "left")
    kept = F.when(F.col(quoted(gone_name)).isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains(F.col(quoted(gone_name)), line_hash(x))))
    return docs, all_lines, kept


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, filter_lines: int = FILTER_LINES, counts: bool = True) -> DataFrame:
    """docs with the boilerplate lines taken from the text, and (with counts) n_lines and n_removed. Kept lines stay as they were, joined by line feeds."""
    folder = shared_dir(docs.sparkSession)
    flagged = boilerplate(columns(docs, doc_id=id_col, text=text_col, site=site_col), min_sites, folder)
    replaced = ["n_lines", "n_removed"] if counts else []
    names = [c for c in docs.columns if c.lower() not in replaced]
    joined, all_lines, kept = without_lines(docs, flagged, text_col, id_col, filter_lines)
    (left,) = fresh(joined.columns, "left")
    joined = joined.withColumn(left, kept)
    text = F.col(quoted(text_col))
    n, m = F.size(all_lines), F.size(F.col(quoted(left)))
    new = F.when(m == n, text).otherwise(F.array_join(F.col(quoted(left)), "\n"))
    same = [F.col(quoted(c)) if c != text_col else new.alias(text_col) for c in names]
    if not counts:
        return joined.select(*same)
    zero = F.lit(0).cast("long")
    return joined.select(*same, F.when(text.isNull(), zero).otherwise(n.cast("long")).alias("n_lines"), F.when(text.isNull(), zero).otherwise((n - m).cast("long")).alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every document."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)),
b AS (SELECT norm FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (norm IN (SELECT norm FROM b)) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (norm NOT IN (SELECT norm FROM b)), '') AS text
  FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN k.text END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
