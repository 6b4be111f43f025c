"""Queries on metadata records: malformed lines, on-air periods, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import hierarchy as tree
from ..operators import intervals, malformed


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cannot be loaded, with the reason."""
    return malformed.load(_t(spark, d, "raw_metadata_lines"))[1].select("line_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed rows of the valid lines."""
    return malformed.load(_t(spark, d, "raw_metadata_lines"))[0].select("line_id", "index", "label", "modcod", "sample_rate")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods on air and gaps between them, per sample."""
    spans = intervals.periods(_t(spark, d, "signal_metadata"), "sample_id", "start_in_samples", "duration_in_samples")
    return spans.select("sample_id", "span_kind", F.col("span_from").alias("from_sample"), F.col("span_to").alias("to_sample"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and state of every metadata group."""
    return tree.hierarchy(_t(spark, d, "metadata_nodes")).select("metadata_id", F.col("root_id").alias("root_metadata_id"), F.col("depth").alias("node_depth"), F.col("state").alias("node_state"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path and number of descendants of every metadata group."""
    return tree.paths(tree.hierarchy(_t(spark, d, "metadata_nodes")))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every group with each of its descendants."""
    return tree.descendants(tree.hierarchy(_t(spark, d, "metadata_nodes")))


LINES = r"""
WITH l AS (SELECT line_id, coalesce(raw_line, '') AS s FROM raw_metadata_lines),
     q AS (SELECT line_id, regexp_full_match(s, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*\r?') AS fits,
                  regexp_extract_all(',' || regexp_replace(s, '\r$', ''), '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS f FROM l),
     w AS (SELECT line_id, fits, f, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE trim(x, ' ' || chr(9)) END) AS v FROM q),
     c AS (SELECT line_id, v, CASE WHEN NOT fits THEN 'broken_quoting' WHEN len(f) <> 4 THEN 'column_count'
             WHEN regexp_full_match(v[1], '[+-]?[0-9]+') AND try_cast(v[1] AS BIGINT) IS NOT NULL AND trim(v[2]) <> ''
              AND regexp_full_match(v[3], '[+-]?[0-9]+') AND try_cast(v[3] AS INTEGER) IS NOT NULL
              AND regexp_full_match(v[4], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
              AND coalesce(try_cast(v[4] AS DOUBLE) > 0 AND isfinite(try_cast(v[4] AS DOUBLE)), false) THEN NULL
             ELSE 'invalid_value' END AS reason FROM w)
"""
PERIODS = """
WITH r AS (SELECT DISTINCT sample_id, start_in_samples AS s, start_in_samples + duration_in_samples AS t FROM signal_metadata
           WHERE start_in_samples IS NOT NULL AND duration_in_samples > 0),
     m AS (SELECT *, max(t) OVER (PARTITION BY sample_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
     i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM m),
     p AS (SELECT sample_id, island, min(s) AS a, max(t) AS b FROM i GROUP BY ALL),
     g AS (SELECT sample_id, b, lead(a) OVER (PARTITION BY sample_id ORDER BY a) AS nxt FROM p)
SELECT sample_id, 'period' AS span_kind, a AS from_sample, b AS to_sample FROM p
UNION ALL SELECT sample_id, 'gap', b, nxt FROM g WHERE nxt IS NOT NULL
"""
NODES = """
WITH RECURSIVE n AS (SELECT metadata_id AS id, min(nullif(trim(parent_metadata_id), '')) AS parent FROM metadata_nodes GROUP BY metadata_id),
     walk AS (SELECT id AS start, id AS cur, parent AS nxt, 0 AS steps, [id] AS path FROM n
              UNION ALL SELECT w.start, n.id, n.parent, w.steps + 1, list_append(w.path, n.id) FROM walk w JOIN n ON n.id = w.nxt WHERE NOT list_contains(w.path, n.id)),
     last AS (SELECT w.* FROM walk w JOIN (SELECT start, max(steps) AS steps FROM walk GROUP BY start) m ON w.start = m.start AND w.steps = m.steps),
     e AS (SELECT l.*, list_position(l.path, l.nxt) AS enters FROM last l),
     a AS (SELECT start, CASE WHEN enters IS NOT NULL AND enters > 0 THEN list_min(path[enters:]) ELSE cur END AS root_metadata_id,
                  (CASE WHEN enters > 0 THEN enters - 1 ELSE steps END)::BIGINT AS node_depth,
                  CASE WHEN nxt IS NULL THEN 'tree' WHEN enters = 1 THEN 'cycle' WHEN enters > 1 THEN 'below_cycle' ELSE 'dangling' END AS node_state, path, enters FROM e)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p3_found, p5_found, p5_paths, p5_descendants)}
SQL = {
    "p2_found": LINES + "SELECT line_id, reason FROM c WHERE reason IS NOT NULL",
    "p2_loaded": LINES + "SELECT line_id, v[1]::BIGINT AS index, v[2] AS label, v[3]::INTEGER AS modcod, v[4]::DOUBLE AS sample_rate FROM c WHERE reason IS NULL",
    "p3_found": PERIODS,
    "p5_found": NODES + "SELECT start AS metadata_id, root_metadata_id, node_depth, node_state FROM a",
    "p5_paths": NODES + """, d AS (SELECT unnest(CASE WHEN enters > 0 THEN path[2:enters] ELSE path[2:] END) AS metadata_id FROM a), c AS (SELECT metadata_id, count(*) AS n FROM d GROUP BY metadata_id)
SELECT start AS metadata_id, array_to_string(list_reverse(CASE WHEN enters > 0 THEN path[1:enters] ELSE path END), '/') AS path, coalesce(n, 0) AS n_descendants FROM a LEFT JOIN c ON c.metadata_id = a.start""",
    "p5_descendants": NODES + "SELECT unnest(CASE WHEN enters > 0 THEN path[2:enters] ELSE path[2:] END) AS metadata_id, start AS descendant FROM a",
}
