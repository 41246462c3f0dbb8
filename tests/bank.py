"""A tiny bank written out by hand: landing files of all eight feeds."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from ledgerloom.schemas import FEEDS

AS_OF = "2024-06-30"


def _csv(folder: Path, name: str, columns: list[str], rows: list[dict]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "w", newline="") as handle:
        out = csv.DictWriter(handle, columns, restval="")
        out.writeheader()
        out.writerows(rows)


def _json(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def customer(n: int, **extra) -> dict:
    return {
        "cif_number": f"CIF{n:06}", "party_id": f"P{n:08}", "legal_name": f"Customer {n}", "date_of_birth": "1990-01-01",
        "annual_income_amount": 90000.0, "number_of_dependents": 1, "lifecycle_status": "active", "customer_segment": "affluent",
        "relationship_start_date": "2019-06-30", "record_updated_timestamp": "2024-01-01 00:00:00", "net_worth_band": "500K-1M",
        "employment_status": "permanent_employee", "is_shariah_preferred": "true", "postcode": "01234", **extra,
    }


def write_first(root: Path) -> None:
    names = {n: f.schema.fieldNames() for n, f in FEEDS.items()}
    v1 = root / "batch_v1"
    _csv(v1 / "customer_master", "a.csv", names["customer_master"], [
        customer(1), customer(2, nps_score=8), customer(3, lifecycle_status="closed"), customer(4, legal_name="", annual_income_amount="lots"),
    ])
    account = lambda i, n, kind, status, balance: {
        "deposit_account_id": i, "party_id": f"P{n:08}", "account_type": kind, "account_status": status, "current_balance": balance,
        "last_modified_timestamp": "2024-01-01",
    }
    _csv(v1 / "accounts", "a.csv", names["accounts"], [
        account("A1", 1, "savings_i", "active", 100.25), account("A2", 1, "DDA", "active", 200.5), account("A3", 1, "DDA", "closed", 50.0),
        account("A4", 2, "certificate_of_deposit", "active", 10.0),
    ])
    loan = lambda i, n, kind, status, owed: {
        "loan_account_id": i, "party_id": f"P{n:08}", "loan_type": kind, "loan_status": status, "outstanding_principal_myr": owed,
        "monthly_installment_myr": owed / 100, "disbursement_date": "2020-01-01", "last_modified_timestamp": "2024-01-01",
    }
    _csv(v1 / "loans", "a.csv", names["loans"], [loan("L1", 1, "home_loan", "active", 5000.0), loan("L2", 1, "hire_purchase", "settled", 70.0)])
    txn = lambda i, n, kind, amount, day, **x: {
        "payment_transaction_id": i, "party_id": f"P{n:08}", "txn_type": kind, "payment_amount": amount, "posting_date": day, "value_date": day,
        "currency_id": "MYR", "payment_rail_type": "FPX", "instruction_status": "settled", "sanctions_screening_status": "CLEARED", **x,
    }
    _csv(v1 / "transactions", "a.csv", names["transactions"], [
        txn("T1", 1, "DEBIT", 10.5, "2024-06-20"), txn("T2", 1, "CREDIT", 20.0, "2024-06-01"), txn("T3", 1, "DEBIT", 30.0, "2024-04-15"),
        txn("T4", 1, "DEBIT", 40.0, "2023-08-01"), txn("T5", 1, "DEBIT", 50.0, "2020-01-01"),
        txn("", 1, "DEBIT", 9.0, "2024-06-20"), txn("T7", 1, "DEBIT", -9.0, "2024-06-20"), txn("T8", 2, "DEBIT", 1.0, "2024-06-20", currency_id="XXX"),
    ])
    card = lambda i, n, kind, amount, day, abroad: {
        "card_instruction_id": i, "party_id": f"P{n:08}", "card_type": kind, "txn_amount": amount, "posting_date": day, "is_overseas": abroad,
        "instruction_status": "settled",
    }
    _csv(v1 / "cards", "a.csv", names["cards"], [
        card("C1", 2, "debit", 15.0, "2024-06-29", "true"), card("C2", 4, "credit", 25.0, "2024-06-29", "false"), card("C3", 4, "credit", 35.0, "2024-01-01", "false"),
    ])
    pull = lambda n, at, score: {
        "cif_number": f"CIF{n:06}", "ctos_score": score, "bureau_pull_timestamp": at, "ccris_status": "30_dpd", "payment_conduct_12m": "clean",
        "bankruptcy_status": "none", "monthly_total_commitment_myr": 12.5, "total_credit_facilities": 2, "inquiry_count_last_6m": 1,
    }
    _json(root / "credit_bureau", "a.json", [pull(1, "2024-01-01 00:00:00", 650), pull(1, "2024-05-01 00:00:00", 720), pull(2, "2024-01-01 00:00:00", 800)])
    event = lambda i, n, kind, at, product=None: {
        "event_id": i, "party_id": f"P{n:08}", "event_type": kind, "event_timestamp": at, "product_category_viewed": product,
    }
    _json(root / "digital_events", "a.json", [
        event("E1", 1, "login", "2024-06-25 10:00:00"), event("E2", 1, "view_product", "2024-06-26 10:00:00", "home_loan"),
        event("E3", 1, "view_product", "2024-06-20 10:00:00", "insurance"), event("E4", 1, "view_product", "2024-01-01 10:00:00", "credit_card"),
    ])
    _json(root / "digital_events", "b.json", [event("E5", 1, "logout", "2024-06-27 10:00:00"), {"event_id": "E6", "event_type": "login"}])
    signal = lambda i, n, maturity, mb: {
        "event_id": i, "party_id": f"P{n:08}", "digital_maturity_score": maturity, "data_consumption_mb_monthly": mb, "arpu_myr": 60.0,
    }
    _json(root / "telco_events", "a.json", [signal("S1", 1, 6.0, 2048.0), signal("S2", 1, 8.0, 4096.0), signal("S3", 4, 3.0, 1024.0)])


def write_second(root: Path) -> None:
    """Customer 2 changes 30 days later; the new file has one more column."""
    columns = FEEDS["customer_master"].schema.fieldNames() + ["occupation_code"]
    changed = customer(2, annual_income_amount=150000.0, record_updated_timestamp="2024-01-31 00:00:00", occupation_code="OC7")
    _csv(root / "batch_v2" / "customer_master", "b.csv", columns, [changed])
    late = {
        "deposit_account_id": "A1", "party_id": "P00000001", "account_type": "savings_i", "account_status": "active", "current_balance": 1.0,
        "last_modified_timestamp": "2023-06-01",
    }
    _csv(root / "batch_v1" / "accounts", "late.csv", FEEDS["accounts"].schema.fieldNames(), [late])
