"""Queries of the core, by name: callables (spark, folder) -> DataFrame, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import ledger
from .plans.shared import table

#: The query of ``entry``.
FLAGSHIP = "p2_found"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    """
    WITH ok AS (SELECT DISTINCT run_id FROM crawl_runs WHERE job = 'freshness' AND status = 'ok'),
    seen AS (SELECT * FROM (SELECT url, now_s, content_hash, row_number() OVER (PARTITION BY url ORDER BY now_s DESC, event_id DESC, content_hash DESC) AS k
             FROM freshness_events WHERE content_hash IS NOT NULL AND url IS NOT NULL) WHERE k = 1),
    known AS (SELECT * FROM (SELECT url, last_checked, content_hash, row_number() OVER (PARTITION BY url ORDER BY run_id DESC, last_checked DESC NULLS LAST, content_hash DESC NULLS LAST) AS k
              FROM freshness WHERE run_id IN (SELECT run_id FROM ok) AND url IS NOT NULL) WHERE k = 1)
    SELECT s.url, s.content_hash FROM seen s LEFT JOIN known n ON s.url = n.url
    WHERE n.url IS NULL OR n.content_hash IS NULL OR (s.now_s > n.last_checked AND s.content_hash <> n.content_hash)
    """
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.next_run(
        table(spark, sf_dir, "freshness_events"), table(spark, sf_dir, "freshness"), table(spark, sf_dir, "crawl_runs")
    )


@query(
    """
    WITH ran AS (SELECT run_id, bool_or(status = 'ok') AS ok FROM crawl_runs WHERE job = 'freshness' GROUP BY run_id),
    one AS (SELECT f.url, f.run_id, coalesce(r.ok, false) AS ok, max(f.content_hash) AS h FROM freshness f JOIN ran r ON f.run_id = r.run_id WHERE f.url IS NOT NULL GROUP BY ALL),
    step AS (SELECT *, CASE WHEN h IS NOT DISTINCT FROM lag(h) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM one WINDOW w AS (PARTITION BY url ORDER BY run_id)),
    part AS (SELECT *, sum(new) OVER (PARTITION BY url ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS k FROM step),
    last AS (SELECT url, max(k) AS k FROM part GROUP BY url)
    SELECT p.url, any_value(p.h) AS content_hash, CASE WHEN bool_or(p.ok) THEN 'done' ELSE 'pending' END AS state
    FROM part p JOIN last l ON p.url = l.url AND p.k = l.k GROUP BY p.url
    """
)
def p2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after all runs, failed and unfinished ones too: leases, tokens, commits."""
    return ledger.replay(table(spark, sf_dir, "freshness"), table(spark, sf_dir, "crawl_runs"))


from . import queries_search, queries_web  # noqa: E402

for _more in (queries_search, queries_web):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL
FLAGSHIP = "bm25_topk"
