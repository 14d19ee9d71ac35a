"""Queries of pass-through without a limit and the rule set of five detectors."""

from __future__ import annotations

from ledgerloom.operators import passthrough as P
from ledgerloom.plans.registry import TXN, query
from ledgerloom.sources.adapters import transactions

WORDS = ["signup", "Purchase {\"k\": 7"]
DRAINS = """SELECT i.tx_id AS in_id, min(o.tx_id) AS out_id FROM txn i JOIN txn o ON i.is_credit AND NOT o.is_credit AND o.amount > 0 AND i.amount >= 2000 AND o.tx_id > i.tx_id
    AND o.amount * 100 >= i.amount * 90 AND o.amount <= i.amount GROUP BY i.tx_id"""


@query("aml_later_drains", f"{TXN} {DRAINS}")
def _(spark, d):
    """Every credit with the first later debit of 90 to 100 per cent of it, on any account."""
    return P.later_drains(transactions(spark, d))


@query(
    "aml_five_detectors",
    f"""{TXN}, dr AS ({DRAINS}), days AS (SELECT ts // 86400 AS day, sum(amount) AS total FROM txn WHERE amount > 0 AND amount < 20000 GROUP BY 1 HAVING count(*) >= 3 AND sum(amount) >= 20000)
    SELECT 'HIGH_VALUE' AS kind, CASE WHEN amount >= 30000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, tx_id AS alert, tx_id, amount AS total FROM txn WHERE amount >= 20000
    UNION ALL SELECT 'STRUCTURING_SMURFING', 'CRITICAL', day, tx_id, CAST(total AS BIGINT) FROM txn JOIN days ON ts // 86400 = day WHERE amount > 0 AND amount < 20000
    UNION ALL SELECT 'NIGHT_VELOCITY', 'HIGH', tx_id, tx_id, amount FROM txn WHERE amount >= 10000 AND (ts % 86400 // 3600 >= 23 OR ts % 86400 // 3600 < 5)
    UNION ALL SELECT 'RAPID_PASS_THROUGH', 'CRITICAL', in_id, unnest([in_id, out_id]), amount FROM dr JOIN txn ON tx_id = in_id
    UNION ALL SELECT 'WATCHLIST_HIT', 'CRITICAL', tx_id, tx_id, amount FROM txn WHERE contains(lower(narration), 'signup') OR contains(lower(narration), 'purchase {{"k": 7')""",
)
def _(spark, d):
    return P.five_detectors(transactions(spark, d), WORDS)
