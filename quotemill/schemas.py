"""Declared table shapes: columns, keys and the date column of each table.

Spark has no primary key, so the key lists here are what the keyed writes in
``operators.merge`` and the uniqueness checks in ``quality`` enforce.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names of the market tables -----------------------
_SECURITIES = (
    "code STRING, display_name STRING, name STRING, start_date DATE, end_date DATE, "
    "exchange STRING, market STRING, security_type STRING, industry_code STRING, "
    "industry_name STRING, sector_code STRING, sector_name STRING, status STRING, "
    "is_st BOOLEAN, update_date DATE"
)

_PRICE_NUMBERS_1 = "open close high low pre_close volume money factor high_limit low_limit avg"
_PRICE_NUMBERS_2 = "adj_close adj_factor"

_VALUATION = (
    "capitalization circulating_cap market_cap circulating_market_cap turnover_ratio pe_ratio "
    "pe_ratio_lyr pb_ratio ps_ratio pcf_ratio pcf_ratio2 dividend_ratio free_cap "
    "free_market_cap a_cap a_market_cap"
)

_INDICATOR = (
    "eps adjusted_profit operating_profit value_change_profit roe inc_return roa "
    "net_profit_margin gross_profit_margin expense_to_total_revenue "
    "operation_profit_to_total_revenue net_profit_to_total_revenue "
    "operating_expense_to_total_revenue ga_expense_to_total_revenue "
    "financing_expense_to_total_revenue operating_profit_to_profit "
    "invesment_profit_to_profit adjusted_profit_to_profit "
    "goods_sale_and_service_to_revenue ocf_to_revenue ocf_to_operating_profit "
    "inc_total_revenue_year_on_year inc_total_revenue_annual inc_revenue_year_on_year "
    "inc_revenue_annual inc_operation_profit_year_on_year inc_operation_profit_annual "
    "inc_net_profit_year_on_year inc_net_profit_annual "
    "inc_net_profit_to_shareholders_year_on_year inc_net_profit_to_shareholders_annual"
)

_MARGIN = (
    "fin_value fin_buy_value fin_refund_value sec_value sec_sell_value sec_refund_value "
    "fin_sec_value"
)
_FLOW = " ".join(f"{way}_{size}" for way in ("inflow", "outflow", "netflow")
                 for size in ("xl", "l", "m", "s"))

_DAILY_BASIC = (
    "close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm "
    "total_share float_share free_share total_mv circ_mv"
)

_INCOME = (
    "total_operating_revenue operating_revenue interest_income premiums_earned "
    "commission_income total_operating_cost operating_cost interest_expense "
    "commission_expense refunded_premiums net_pay_insurance_claims "
    "withdraw_insurance_contract_reserve policy_dividend_payout reinsurance_cost "
    "operating_tax_surcharges sale_expense administration_expense exploration_expense "
    "financial_expense asset_impairment_loss fair_value_variable_income investment_income "
    "invest_income_associates exchange_income other_items_influenced_income operating_profit "
    "subsidy_income non_operating_revenue non_operating_expense "
    "disposal_loss_non_current_liability total_profit income_tax net_profit "
    "np_parent_company_owners minority_profit eps basic_eps diluted_eps "
    "other_composite_income total_composite_income ci_parent_company_owners "
    "ci_minority_owners"
)

_CASHFLOW = (
    "goods_sale_and_service_render_cash net_deposit_increase "
    "net_borrowing_from_central_bank net_borrowing_from_finance_co "
    "net_original_insurance_cash net_cash_received_from_reinsurance_business "
    "net_insurer_deposit_investment net_deal_trading_assets interest_and_commission_cashin "
    "net_increase_in_placements net_buyback tax_levy_refund other_cashin_related_operate "
    "subtotal_operate_cash_inflow goods_and_services_cash_paid net_loan_and_advance_increase "
    "net_deposit_in_cb_and_ib original_compensation_paid handling_charges_and_commission "
    "policy_dividend_cash_paid staff_behalf_paid tax_payments other_cash_paid_related_operate "
    "subtotal_operate_cash_outflow net_operate_cash_flow invest_withdrawal_cash "
    "invest_proceeds fix_intan_other_asset_dispo_cash net_cash_deal_subcompany "
    "other_cash_from_invest_act subtotal_invest_cash_inflow fix_intan_other_asset_acqui_cash "
    "invest_cash_paid impawned_loan_net_increase net_cash_from_sub_company "
    "other_cash_to_invest_act subtotal_invest_cash_outflow net_invest_cash_flow "
    "cash_from_invest cash_from_borrowing cash_from_bonds_issue other_cash_from_finance_act "
    "subtotal_finance_cash_inflow borrowing_repayment dividend_interest_payment "
    "other_cash_to_finance_act subtotal_finance_cash_outflow net_finance_cash_flow "
    "exchange_rate_change_effect cash_equivalent_increase cash_equivalents_at_beginning "
    "cash_and_equivalents_at_end"
)

_BALANCE = (
    "cash_equivalents settlement_provi lend_capital trading_assets bill_receivable "
    "account_receivable advance_payment insurance_receivables reinsurance_receivables "
    "reinsurance_contract_reserves_receivable interest_receivable dividend_receivable "
    "other_receivable bought_sellback_assets inventories expendable_biological_asset "
    "non_current_asset_in_one_year other_current_assets total_current_assets "
    "loan_and_advance_current available_for_sale_assets held_to_maturity_investments "
    "long_term_receivable long_term_equity_invest investment_real_estate fixed_assets "
    "constru_in_process construction_materials fixed_assets_liquidation biological_assets "
    "oil_and_gas_assets intangible_assets development_expenditure good_will "
    "long_deferred_expense deferred_tax_assets other_non_current_assets "
    "total_non_current_assets total_assets short_term_loan borrowing_from_central_bank "
    "lend_capital_liability trading_liability notes_payable accounts_payable "
    "advance_peceipts sold_buyback_secu_proceeds commission_payable salaries_payable "
    "taxs_payable interest_payable dividend_payable other_payable reinsurance_payables "
    "insurance_contract_reserves proxy_secu_proceeds "
    "receivings_from_vicariously_sold_securities non_current_liability_in_one_year "
    "other_current_liability total_current_liability long_term_loan bonds_payable "
    "long_term_account_payable specific_account_payable estimated_liability "
    "deferred_tax_liability other_non_current_liability total_non_current_liability "
    "total_liability paidin_capital other_equity_tools other_equity_tools_PRE_STOCK "
    "other_equity_tools_PERPETUAL_DEBT other_equity_tools_OTHER capital_reserve_fund "
    "treasury_stock other_comprehensive_income specific_reserves earned_surplus "
    "general_risk_preparation undistributed_profit foreign_exchange_gain "
    "total_owner_equities minority_interests total_sheet_owner_equities "
    "total_liability_equity"
)

_TRANSACTIONS = (
    "trade_id STRING, user_id STRING, stock_code STRING, trade_date DATE, "
    "trade_time TIMESTAMP_NTZ, trade_type INT, strategy_id STRING, quantity DOUBLE, "
    "price DOUBLE, amount DOUBLE, commission DOUBLE, stamp_tax DOUBLE, other_fees DOUBLE, "
    "net_amount DOUBLE, order_id STRING, remark STRING, created_at TIMESTAMP_NTZ"
)
_POSITIONS = (
    "position_id STRING, user_id STRING, position_date DATE, stock_code STRING, "
    "position_quantity INT, available_quantity INT, frozen_quantity INT, "
    "transit_shares INT, yesterday_quantity INT, open_price DOUBLE, market_value DOUBLE, "
    "current_price DOUBLE, unrealized_pnl DOUBLE, unrealized_pnl_ratio DOUBLE, "
    "remark STRING, timestamp TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)
_ACCOUNTS = (
    "user_id STRING, info_date DATE, total_assets DOUBLE, position_market_value DOUBLE, "
    "available_cash DOUBLE, frozen_cash DOUBLE, total_profit_loss DOUBLE, "
    "total_profit_loss_ratio DOUBLE, timestamp TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)
_ISSUES = (
    "severity STRING, category STRING, table_name STRING, check_name STRING, "
    "description STRING, count BIGINT, samples ARRAY<STRING>"
)
# --- end of fixed values ----------------------------------------------------


def _doubles(names: str) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names.split())


def _statement(names: str) -> str:
    return f"code STRING, pub_date DATE, stat_date DATE, report_type INT, {_doubles(names)}"


_DDL = {
    "stock_list": _SECURITIES,
    "price_data": (f"code STRING, day DATE, {_doubles(_PRICE_NUMBERS_1)}, paused INT, "
                   f"{_doubles(_PRICE_NUMBERS_2)}"),
    "valuation_data": f"code STRING, day DATE, {_doubles(_VALUATION)}",
    "indicator_data": f"code STRING, pubDate DATE, statDate DATE, {_doubles(_INDICATOR)}",
    "mtss_data": f"code STRING, day DATE, {_doubles(_MARGIN + ' ' + _FLOW)}",
    "daily_basic": f"code STRING, day DATE, {_doubles(_DAILY_BASIC)}",
    "income_statement": _statement(_INCOME),
    "cashflow_statement": _statement(_CASHFLOW),
    "balance_sheet": _statement(_BALANCE),
    "user_transactions": _TRANSACTIONS,
    "user_positions": _POSITIONS,
    "user_account_info": _ACCOUNTS,
}

_TYPES = {"STRING": T.StringType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType(),
          "INT": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(),
          "TIMESTAMP_NTZ": T.TimestampNTZType(), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _struct(columns: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {t: _struct(ddl) for t, ddl in _DDL.items()}
ISSUES = _struct(_ISSUES)

KEYS: dict[str, list[str]] = {
    "stock_list": ["code"],
    "price_data": ["code", "day"],
    "valuation_data": ["code", "day"],
    "indicator_data": ["code", "pubDate", "statDate"],
    "mtss_data": ["code", "day"],
    "daily_basic": ["code", "day"],
    "income_statement": ["code", "stat_date", "report_type"],
    "cashflow_statement": ["code", "stat_date", "report_type"],
    "balance_sheet": ["code", "stat_date", "report_type"],
    "user_transactions": ["trade_id"],
    "user_positions": ["user_id", "stock_code", "position_date"],
    "user_account_info": ["user_id", "info_date"],
}

# Column that says how recent a row is (high-water mark of the incremental loads).
WATERMARK: dict[str, str] = {
    "price_data": "day",
    "valuation_data": "day",
    "mtss_data": "day",
    "daily_basic": "day",
    "indicator_data": "pubDate",
    "income_statement": "stat_date",
    "cashflow_statement": "stat_date",
    "balance_sheet": "stat_date",
    "user_transactions": "trade_date",
    "user_positions": "position_date",
    "user_account_info": "info_date",
}

# Folder column of tables stored by the year of their WATERMARK date.
PARTITION_YEAR = "part_year"

STATEMENTS = ("income_statement", "cashflow_statement", "balance_sheet")
MARGIN_COLUMNS = _MARGIN.split()
FLOW_COLUMNS = _FLOW.split()

BUY, SELL = 23, 24
SUFFIXES = (".SH", ".SZ", ".BJ")
