"""DuckDB SQL that states the result of each registered query independently."""

from __future__ import annotations

_LOGS = """WITH ev AS (
  SELECT concat('user/', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS k, event_id + 1 AS revision, event_type = 'error' AS deleted, event_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '|', CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) END AS v
  FROM events),
od AS (
  SELECT concat('cust/', lpad(CAST(o_custkey AS VARCHAR), 8, '0')) AS k, o_orderkey + 1 AS revision, o_orderstatus = 'F' AS deleted,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS v
  FROM orders)"""


def _latest(source: str, where: str = "true") -> str:
    return f"(SELECT k, revision, deleted, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY revision DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


def _visible(source: str, where: str = "true") -> str:
    return f"(SELECT k, v, revision FROM {_latest(source, where)} WHERE NOT deleted)"


def _scan(source: str = "ev", where: str = "true", tail: str = "") -> str:
    return f"{_LOGS} SELECT k, v, revision FROM {_visible(source, where)} {tail}"


def _found(keys: str, source: str) -> str:
    return f"{_LOGS} SELECT q.k, s.k IS NOT NULL AS found, s.v, s.revision FROM {keys} q LEFT JOIN {_visible(source)} s ON q.k = s.k"


def _retained(source: str, snapshot: str, gc: bool) -> str:
    return (
        f"(SELECT k, revision, deleted, v FROM (SELECT *, row_number() OVER (PARTITION BY k, revision <= {snapshot} ORDER BY revision DESC) AS rn,"
        f" max(revision) OVER (PARTITION BY k) AS mx FROM {source}) WHERE revision > {snapshot} OR (rn = 1 AND NOT ({str(gc).lower()} AND deleted AND NOT mx > {snapshot})))"
    )


_HALF_EV, _HALF_OD = "(SELECT max(revision) // 2 FROM ev)", "(SELECT max(revision) // 2 FROM od)"
_END = "9223372036854775806"


def _fold(guarded: str, wants: str) -> str:
    """A guarded event fails or applies by whether its key existed before: which the last event that is not a
    failed one decides, in closed form for put-if-missing and put-if-present."""
    return f"{_LOGS}, z AS (SELECT k, revision, event_type, deleted, lag(event_type) OVER (PARTITION BY k ORDER BY revision) AS prev FROM ev) SELECT revision, NOT (event_type = '{guarded}' AND {wants}) AS applied FROM z"


ORACLES: dict[str, str] = {
    "scan_all": _scan(),
    "scan_from": _scan("ev", "k >= 'user/00000050'"),
    "scan_until": _scan("ev", "k < 'user/00000050'"),
    "scan_between": _scan("ev", "k >= 'user/00000010' AND k < 'user/00000020'"),
    "scan_empty_range": _scan("ev", "k >= 'user/00000010' AND k < 'user/00000010'"),
    "scan_prefix": _scan("od", "k LIKE 'cust/000000%'"),
    "scan_limit": _scan("ev", "true", "ORDER BY k LIMIT 10"),
    "scan_limit_unbounded": _scan(),
    "get_point": _found("(SELECT 'user/00000007' AS k)", "ev"),
    "get_missing": _found("(SELECT 'user/99999999' AS k)", "ev"),
    "get_tombstoned": _found(f"(SELECT k FROM {_latest('ev')} WHERE deleted)", "ev"),
    "multi_get": _found("(SELECT concat('cust/', lpad(CAST(c_custkey * 7 AS VARCHAR), 8, '0')) AS k FROM customer)", "od"),
    "latest_entries": f"{_LOGS} SELECT k, revision, deleted, v FROM {_latest('ev')}",
    **{
        f"read_view_at_{p}": f"{_LOGS} SELECT k, v, revision FROM {_visible('ev', f'revision <= (SELECT max(revision) * {p} // 100 FROM ev)')}"
        f" UNION ALL SELECT k, v, revision FROM {_visible('od', f'revision <= (SELECT max(revision) * {p} // 100 FROM od)')}"
        for p in (25, 50, 75)
    },
    "merge_sources": _scan(),
    "apply_batch": f"""{_LOGS}, b AS (SELECT k, (revision - 1) // 10 + 1 AS batch, revision AS r, deleted, v FROM ev),
c AS (SELECT k, batch AS revision, deleted, v FROM (SELECT *, row_number() OVER (PARTITION BY k, batch ORDER BY r DESC) AS n FROM b) WHERE n = 1)
SELECT k, v, revision FROM {_visible("c", "revision <= (SELECT max(revision) // 2 FROM c)")}""",
    "validate_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "validate_classify": f"""{_LOGS}, cur AS (SELECT * FROM {_latest("ev", f"revision <= {_HALF_EV}")}),
inc AS (SELECT k, revision, deleted, v FROM ev UNION ALL SELECT k, revision, false, concat('x', coalesce(v, '')) FROM ev WHERE revision % 5 = 0)
SELECT i.k, i.revision, CASE WHEN c.k IS NULL OR i.revision > c.revision THEN 'apply' WHEN i.revision < c.revision THEN 'stale'
  WHEN i.deleted = c.deleted AND i.v IS NOT DISTINCT FROM c.v THEN 'duplicate' ELSE 'conflict' END AS cls
FROM inc i LEFT JOIN cur c ON i.k = c.k""",
    # A failed sign-up means that the key existed, and leaves it so; after any event but an error the key exists.
    "txn_missing_fold": _fold("signup", "prev IS NOT NULL AND prev <> 'error'"),
    # A purchase on a missing key fails and leaves it missing: the last event other than a purchase decides.
    "txn_exists": f"""{_LOGS}, g AS (SELECT *, sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY revision) AS grp FROM ev),
f AS (SELECT k, grp, max(CASE WHEN event_type <> 'purchase' AND NOT deleted THEN 1 ELSE 0 END) AS alive FROM g GROUP BY k, grp)
SELECT g.revision, g.event_type <> 'purchase' OR f.alive = 1 AS applied FROM g JOIN f ON g.k = f.k AND g.grp = f.grp""",
    "txn_value_equals": """SELECT o_orderkey + 1 AS revision, coalesce(min(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)
  OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS applied FROM orders""",
    "txn_revision_equals": f"""{_LOGS}, q AS (SELECT * FROM (SELECT k, revision, lag(revision) OVER (PARTITION BY k ORDER BY revision) AS before FROM ev)
  WHERE revision > {_HALF_EV} AND before IS NOT NULL)
SELECT q.revision AS id, coalesce(s.revision = q.before, false) AS holds FROM q LEFT JOIN {_visible("ev", f"revision <= {_HALF_EV}")} s ON q.k = s.k""",
    "txn_multi_condition": f"""{_LOGS}, q AS (SELECT e.event_id + 1 AS id, concat('user/', lpad(CAST(e.user_id AS VARCHAR), 8, '0')) AS k,
  concat('user/', lpad(CAST(e.user_id + 1 AS VARCHAR), 8, '0')) AS other FROM events e WHERE e.event_id + 1 > {_HALF_EV}),
s AS (SELECT * FROM {_visible("ev", f"revision <= {_HALF_EV}")})
SELECT q.id, a.k IS NOT NULL AND b.k IS NULL AS holds FROM q LEFT JOIN s a ON q.k = a.k LEFT JOIN s b ON q.other = b.k""",
    "compact_latest": f"{_LOGS} SELECT k, revision, deleted, v FROM {_retained('ev', _END, False)}",
    "compact_gc": f"{_LOGS} SELECT k, revision, deleted, v FROM {_retained('ev', _END, True)}",
    "compact_with_snapshot": f"{_LOGS} SELECT k, revision, deleted, v FROM {_retained('ev', _HALF_EV, True)}",
    "compact_preserves_views": f"{_LOGS} SELECT k, v, revision, 'half' AS \"at\" FROM {_visible('od', f'revision <= {_HALF_OD}')} UNION ALL SELECT k, v, revision, 'end' AS \"at\" FROM {_visible('od')}",
    "key_order_whole": "SELECT hex(encode(text)) AS k, doc_id + 1 AS revision, lang AS v, row_number() OVER (ORDER BY encode(text), doc_id) AS place FROM documents",
    "checkpoint_restore": f"{_LOGS} SELECT k, v, revision FROM {_visible('od', f'revision <= {_HALF_OD}')}",
    "replay_idempotent": _scan(),
    "metadata_applied_through": "SELECT max(event_id) + 1 AS applied_index, max(event_id) + 1 AS applied_through FROM events",
    "segment_stats": f"""{_LOGS} SELECT count(*) AS "rows", min(k) AS low, max(k) AS high, min(revision) AS min_revision, max(revision) AS max_revision
FROM ev GROUP BY (revision - 1) // ((SELECT max(revision) FROM ev) // 4 + 1)""",
    "store_put_delete": f"""{_LOGS} SELECT k, v, revision FROM {_visible('ev')} WHERE k NOT IN ('user/00000007', 'user/00000008')
UNION ALL SELECT 'user/00000007', 'set', max(revision) + 1 FROM ev UNION ALL SELECT 'zz/new', '', max(revision) + 2 FROM ev""",
    "store_write_batch": f"""{_LOGS}, gone AS (SELECT concat('cust/', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
w AS (SELECT k, v, revision FROM {_visible('od')} WHERE k NOT IN ('cust/00000001', 'cust/00000002')
UNION ALL SELECT 'cust/00000001', 'one', max(revision) + 1 FROM od UNION ALL SELECT 'zz/new', 'two', max(revision) + 1 FROM od)
SELECT k, v, revision FROM w WHERE k NOT IN (SELECT k FROM gone)""",
    "store_transact": f"""{_LOGS}, t AS (SELECT max(revision) AS base, (SELECT count(*) > 0 FROM {_visible('ev')} WHERE k = 'user/00000007') AS has FROM ev),
r AS (SELECT 1 AS n, has AS applied, base FROM t UNION ALL SELECT 2, true, base FROM t UNION ALL SELECT 3, true, base FROM t UNION ALL SELECT 4, false, base FROM t
UNION ALL SELECT 5, false, base FROM t UNION ALL SELECT 6, true, base FROM t UNION ALL SELECT 7, false, base FROM t)
SELECT n, applied, CASE WHEN applied THEN base + n END AS revision FROM r""",
    "store_transact_state": f"""{_LOGS}, t AS (SELECT max(revision) + 2 AS top FROM ev)
SELECT s.k, s.v, s.revision, top AS applied_index, top AS applied_through FROM (SELECT k, v, revision FROM {_visible('ev')} WHERE k <> 'user/00000007'
UNION ALL SELECT 'zz/a', 'y', top FROM t) s, t""",
    "store_replay": _scan(),
    "store_view_half": f"""{_LOGS}, b AS (SELECT k, (revision - 1) // 10 + 1 AS batch, revision AS r, deleted, v FROM ev),
l AS (SELECT k, batch AS revision, deleted, v FROM (SELECT *, row_number() OVER (PARTITION BY k, batch ORDER BY r DESC) AS n FROM b) WHERE n = 1)
SELECT k, v, revision FROM {_visible('l', 'revision <= (SELECT max(revision) // 2 FROM l)')}""",
    "store_reader_view": f"{_LOGS} SELECT k, v, revision, 'half' AS \"at\" FROM {_visible('od', f'revision <= {_HALF_OD}')} UNION ALL SELECT k, v, revision, 'end' AS \"at\" FROM {_visible('od')}",
    "store_compact": f"{_LOGS} SELECT k, revision, deleted, v FROM {_retained('ev', _END, True)}",
    "store_compact_due": _scan(),
    "store_multi_get": _found("(SELECT concat('cust/', lpad(CAST(c_custkey * 7 AS VARCHAR), 8, '0')) AS k FROM customer)", "od"),
    "store_scan_range": _scan("od", "k >= 'cust/00000010' AND k < 'cust/00000090'", "ORDER BY k LIMIT 25"),
    "store_backup_restore": _scan(),
    "store_stats": """SELECT count(*) AS entries, 4 AS commits, 1 AS rejected, 5 AS proposals, 1 AS failed_proposals, 1 AS checkpoints, 1 AS restores,
0 AS compactions, 0 AS failed_compactions, 0 AS active_compactions FROM events""",
}
ORACLES["key_order_bytes"] = ORACLES["key_order_whole"]
