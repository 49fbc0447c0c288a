"""Registered queries."""

from __future__ import annotations

from dealerlens.operators import checks as ck  # noqa: E402
from dealerlens.plans import derived  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402


@register("check_primary_key", """
WITH o AS (SELECT o_orderkey, count(*) AS n, max(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS has_null
           FROM orders GROUP BY 1),
l AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
             max(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 1 ELSE 0 END) AS has_null
      FROM lineitem GROUP BY 1, 2)
SELECT 'orders' AS table_name, CAST(sum(n) AS BIGINT) AS row_count,
       CAST(sum(CASE WHEN has_null = 1 THEN n ELSE 0 END) AS BIGINT) AS null_key_rows, count(*) AS distinct_keys,
       CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys,
       CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows FROM o
UNION ALL
SELECT 'lineitem', CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN has_null = 1 THEN n ELSE 0 END) AS BIGINT), count(*),
       CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) FROM l""")
def _check_primary_key(fx):
    return (ck.check_primary_key(fx.orders, ["o_orderkey"], "orders")
            .unionByName(ck.check_primary_key(fx.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")))


@register("check_foreign_key", """
SELECT 'interactions.opp_id' AS reference, count(*) AS orphan_rows, count(DISTINCT opp_id) AS orphan_keys
FROM interactions WHERE opp_id IS NULL OR opp_id NOT IN (SELECT opp_id FROM customers WHERE opp_id IS NOT NULL)
UNION ALL
SELECT 'behavior.opp_id', count(*), count(DISTINCT opp_id)
FROM behavior WHERE opp_id IS NULL OR opp_id NOT IN (SELECT opp_id FROM customers WHERE opp_id IS NOT NULL)""")
def _check_foreign_key(fx):
    return (ck.check_foreign_key(derived.interactions(fx), fx.customers, "opp_id", "opp_id", "interactions.opp_id")
            .unionByName(ck.check_foreign_key(derived.behavior(fx), fx.customers, "opp_id", "opp_id", "behavior.opp_id")))


@register("check_domain", """
SELECT 'rating_1_5' AS rule, CAST(sum(CASE WHEN rating BETWEEN 1 AND 5 THEN 0 ELSE 1 END) AS BIGINT) AS violations,
       count(*) AS checked FROM evaluations
UNION ALL SELECT 'match_score_0_100', CAST(sum(CASE WHEN match_score BETWEEN 0 AND 100 THEN 0 ELSE 1 END) AS BIGINT), count(*) FROM recs
UNION ALL SELECT 'role_known', CAST(sum(CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 1 END) AS BIGINT), count(*)
FROM conversations""")
def _check_domain(fx):
    return ck.check_domain(fx.evaluations, fx.recs, fx.conversations)
