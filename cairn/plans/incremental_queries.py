"""Queries and SQL for the incremental operator."""

from cairn.operators.incremental import replay
from cairn.session import table


def p5_changes(spark, d):
    """Every record each succeeded run must handle, with the fields that come along."""
    return replay(table(spark, d, "file_scans"), table(spark, d, "index_runs"), carry=("path", "last_modified", "embed_hash"))


def p5_found(spark, d):
    return replay(table(spark, d, "file_scans"), table(spark, d, "index_runs")).select("run_id", "file_id")


QUERIES = {"p5_found": p5_found, "p5_changes": p5_changes}

_STATES = """
WITH r AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY started_at) AS prev
           FROM (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'succeeded')),
s AS (SELECT file_id, hash, ingested_at, path, last_modified, embed_hash FROM file_scans WHERE hash IS NOT NULL),
cur AS (SELECT run_id, file_id, max(ingested_at) AS at, arg_max(hash, ingested_at) AS hash,
               arg_max(path, ingested_at) AS path,
               arg_max(struct_pack(m := last_modified, e := embed_hash), ingested_at) AS me
        FROM r JOIN s ON s.ingested_at < r.started_at GROUP BY run_id, file_id),
old AS (SELECT run_id, file_id, arg_max(hash, ingested_at) AS hash
        FROM r JOIN s ON s.ingested_at < r.prev GROUP BY run_id, file_id)
"""
SQL = {
    "p5_found": _STATES + "SELECT cur.run_id, cur.file_id FROM cur LEFT JOIN old USING (run_id, file_id) WHERE old.hash IS NULL OR old.hash <> cur.hash",
    "p5_changes": _STATES + "SELECT cur.run_id, cur.file_id, cur.hash, cur.at AS ingested_at, cur.path, cur.me.m AS last_modified, cur.me.e AS embed_hash FROM cur LEFT JOIN old USING (run_id, file_id) WHERE old.hash IS NULL OR old.hash <> cur.hash",
}
