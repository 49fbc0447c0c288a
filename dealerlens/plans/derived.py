"""Spark side of the derived inputs (operator outputs reused as inputs)."""

from __future__ import annotations

from dealerlens.fixtures import Fixtures
from dealerlens.operators import joins, monitoring, text


def interactions(fx: Fixtures):
    return joins.unify_interactions(fx.visits, fx.messages, fx.calls, fx.customers)


def behavior(fx: Fixtures):
    return monitoring.behavior_summary(fx.web_events)


def insights(fx: Fixtures):
    return text.flatten_insights(fx.replies)
