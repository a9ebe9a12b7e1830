"""op4: mixing the sources of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.mixing import mix


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix_sources": op4_mix_sources}
SQL = {
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat(coalesce(cast(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')), ':42')) AS key FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM s),
m AS (SELECT *, [3.0, 1.0, 2.0][p % 3 + 1]::DOUBLE AS weight, cast(2 * source_size AS DOUBLE) AS most, 2 * source_size / [3.0, 1.0, 2.0][p % 3 + 1]::DOUBLE AS ratio FROM w),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights FROM m WINDOW b AS (ORDER BY ratio, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest, weights FROM l WHERE rest / weights <= ratio ORDER BY ratio, p LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT m.weight * rest / weights FROM f), most)) AS target FROM m),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
g AS (SELECT o.*, source_size, target, cast(floor(target + 0.5) AS BIGINT) AS budget FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target, cast(case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) end AS BIGINT) AS taken FROM g"""
}
