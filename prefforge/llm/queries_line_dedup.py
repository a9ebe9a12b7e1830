"""op5: repeated runs of lines in documents, the shortest of three lines or of 20 words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.line_dedup import dedup_lines


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


SQL = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
a AS (SELECT doc_id, i, list(line) OVER x AS lines, words, sum(words) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS two, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
m AS (SELECT doc_id, i, lines, n, case when words >= 20 then 1 when n >= 2 and two >= 20 then 2 else 3 end AS m FROM a),
g AS (SELECT doc_id, i, m, lines[1:m] AS gram FROM m WHERE n >= m),
r AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY gram ORDER BY doc_id NULLS LAST, i) AS k FROM g),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (VALUES (0), (1), (2)) t(o) WHERE k > 1 AND o < m),
s AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM x) GROUP BY doc_id, grp),
t AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM s GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT n.doc_id, n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(removed, '') AS removed
FROM n LEFT JOIN t USING (doc_id)"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
