"""Gold aggregates and the customer-360 table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.plans import gold
from ledgerloom.queries import adapters as a
from ledgerloom.queries.base import Tables, flags_as_int, query


@query(a.CUSTOMER_360)
def q_customer360(t: Tables) -> DataFrame:
    return flags_as_int(a.customer_360(t))


@query(a.AGG_ACCOUNTS)
def q_agg_accounts(t: Tables) -> DataFrame:
    return flags_as_int(gold.agg_accounts(a.accounts(t)))


@query(a.AGG_LOANS)
def q_agg_loans(t: Tables) -> DataFrame:
    return flags_as_int(gold.agg_loans(a.loans(t)))


@query(a.AGG_TRANSACTIONS)
def q_agg_transactions(t: Tables) -> DataFrame:
    return flags_as_int(a.agg_transactions(t))


@query(a.AGG_DIGITAL)
def q_agg_digital(t: Tables) -> DataFrame:
    return flags_as_int(gold.agg_digital(a.activity(t), a.events_as_of()))
