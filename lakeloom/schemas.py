"""Registry of tables: columns, natural keys and references. It takes the place of catalog introspection, and the typed
casts, merges and constraint checks all read it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    references: dict[str, str] = field(default_factory=dict)
    #: An expression over the columns by whose values the table is stored; a merge rewrites only what it touches.
    partition: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.schema}


_DEPOSIT = "deposit_id string, client_id string, deposit_date date, amount_usd decimal(14,2), payment_method string, currency_original string, exchange_rate decimal(12,6), status string, processing_days int, fee_usd decimal(10,2), schema_drift_detected boolean, is_late_arrival boolean, staged_at timestamp"
_RAW = "payload map<string,string>, source_file string, ingested_at timestamp"
_CHANGE = "client_id string, lsn bigint, commit_ts timestamp, op string, before string, after string"
TABLES = {
    t.name: t
    for t in (
        Table("raw.client_signup", f"client_id string, {_RAW}", ("client_id",)),
        Table("raw.client_profile", f"client_id string, {_RAW}", ("client_id",)),
        Table("raw.client_deposit", f"deposit_id string, {_RAW}", ("deposit_id",)),
        Table("raw.client_trades", f"trade_id string, {_RAW}", ("trade_id",)),
        Table("raw.vendor_deposits", f"deposit_id string, {_RAW}", ("deposit_id", "source_file")),
        Table("raw.client_profile_changes", f"{_CHANGE}, source_file string, ingested_at timestamp, raw_seq bigint", ("client_id", "lsn")),
        Table("staging.client_signup", "client_id string, signup_date date, country string, email string, referral_source string, account_type string, kyc_status string, signup_platform string, promo_code string, assigned_manager string, staged_at timestamp", ("client_id",)),
        Table("staging.client_profile", "client_id string, full_name string, date_of_birth date, nationality string, risk_category string, account_balance_usd decimal(14,2), account_status string, currency string, last_login_date date, preferred_language string, staged_at timestamp", ("client_id",)),
        Table("staging.client_deposit", _DEPOSIT, ("deposit_id",)),
        Table("staging.vendor_deposits", _DEPOSIT, ("deposit_id",)),
        Table("staging.client_trades", "trade_id string, client_id string, trade_date date, instrument string, direction string, volume_lots decimal(10,2), open_price decimal(14,5), close_price decimal(14,5), pnl_usd decimal(14,2), trade_status string, staged_at timestamp", ("trade_id",)),
        Table("staging.client_profile_changes", f"{_CHANGE}, staged_at timestamp, staging_seq bigint", ("client_id", "lsn")),
        Table("warehouse.dim_manager", "manager_key bigint, manager_id string, manager_name string", ("manager_id",)),
        Table("warehouse.dim_instrument", "instrument_key bigint, instrument_name string, asset_class string", ("instrument_name",)),
        Table("warehouse.dim_date", "date_key int, full_date date, day_of_week int, day_name string, month int, month_name string, quarter int, year int, is_weekend boolean", ("date_key",)),
        Table("warehouse.dim_client", "client_key bigint, client_id string, full_name string, date_of_birth date, nationality string, country string, currency string, preferred_language string, kyc_status string, account_type string, referral_source string, signup_platform string, promo_code string, signup_date date, manager_key bigint, is_inferred boolean, created_at timestamp, updated_at timestamp", ("client_id",), {"manager_key": "warehouse.dim_manager"}),
        Table("warehouse.dim_client_risk_snapshot", "risk_snapshot_key bigint, client_id string, risk_category string, account_balance_usd decimal(14,2), account_status string, valid_from timestamp, valid_to timestamp, is_current boolean, is_deleted boolean, source_lsn bigint", ("client_id", "source_lsn")),
        Table("warehouse.cdc_watermark", "client_id string, last_applied_lsn bigint", ("client_id",)),
        Table("warehouse.fact_deposits", "deposit_id string, client_key bigint, risk_snapshot_key bigint, date_key int, deposit_date date, amount_usd decimal(14,2), exchange_rate decimal(12,6), fee_usd decimal(10,2), processing_days int, payment_method string, currency_original string, status string, source_system string, is_late_arrival boolean", ("deposit_id",), {"client_key": "warehouse.dim_client", "risk_snapshot_key": "warehouse.dim_client_risk_snapshot", "date_key": "warehouse.dim_date"}, "date_key div 100"),
        Table("warehouse.fact_trades", "trade_id string, client_key bigint, risk_snapshot_key bigint, instrument_key bigint, date_key int, trade_date date, direction string, volume_lots decimal(10,2), open_price decimal(14,5), close_price decimal(14,5), pnl_usd decimal(14,2), trade_status string", ("trade_id",), {"client_key": "warehouse.dim_client", "risk_snapshot_key": "warehouse.dim_client_risk_snapshot", "instrument_key": "warehouse.dim_instrument", "date_key": "warehouse.dim_date"}, "date_key div 100"),
        Table("quarantine.rejected_rows", "table_name string, reason_code string, severity string, raw_payload string, rejected_at timestamp", ()),
        Table("data_quality.dq_check_results", "run_id string, table_name string, check_name string, severity string, passed boolean, unexpected_count int, executed_at timestamp", ("run_id", "table_name", "check_name")),
        Table("data_quality.reconciliation_discrepancies", "reconciliation_name string, run_id string, natural_key string, discrepancy_type string, detected_at timestamp", ("reconciliation_name", "run_id", "natural_key", "discrepancy_type")),
    )
}


def table(name: str) -> Table:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {', '.join(sorted(TABLES))}")
    return TABLES[name]


def references_to(name: str) -> dict[str, str]:
    """Tables with a column that refers to ``name``, and that column."""
    return {t.name: c for t in TABLES.values() for c, to in t.references.items() if to == name}
