"""Rules as data: row predicates judged together, in one scan per table.

All predicates of a table become conditional counts of a single aggregate, so twenty rules
read the table once; a second scan fetches a few samples of each rule that lists rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.codes import has_known_suffix
from quotemill.functions.conditions import (
    CASH,
    account_clash,
    bar_clash,
    below_zero,
    gap_share,
    holding_clash,
    leaves_band,
    misstated_product,
    not_bracketed,
    not_positive,
    outside,
    present,
)
from quotemill.functions.dates import day as as_day
from quotemill.functions.values import percent_text
from quotemill.quality.issues import first_samples, sample_text
from quotemill.schemas import BUY, SELL

# --- fixed values: thresholds of the standard rule set ----------------------
THRESHOLDS = {
    "null_ratio_warning": 0.10,
    "null_ratio_critical": 0.30,
    "price_change_limit": 0.50,
    "max_gap_days": 7,
    "financial_ratio_tolerance": 0.05,
    "amount_tolerance": 0.01,
    "user_data_start_date": "2025-05-12",
    "completion_threshold": 0.95,
    "min_active_securities": 4000,
    "min_recent_codes": 4880,
    "min_quarter_codes": 4340,
    "min_quarter_rows": 3000,
    "max_extreme_prices": 90,
    "max_extreme_valuations": 90,
    "max_invalid_ratios": 5000,
    "max_volatile_moves": 100,
    "max_missing_valuations": 1000,
    "ratio_limit": 1,
    "sample_size": None,  # all securities; a number judges a repeatable sample of them
}

LIMITS = {
    "day_range_share": 0.15,
    "close": (0.01, 1000),
    "pe_ratio": (-1000, 1000),
    "pb_ratio": (0, 100),
    "eps": (-100, 100),
    "asset_gap": 10,
    "statement_gap_share": 0.01,
}

EXCHANGES = ["XSHG", "XSHE", "BSE"]

KEY_FIELDS = {
    "stock_list": ["code", "display_name"],
    "price_data": ["code", "day", "open", "high", "low", "close", "volume"],
    "indicator_data": ["code", "statDate", "eps", "roe"],
    "valuation_data": ["code", "day", "market_cap", "pe_ratio"],
    "user_transactions": ["trade_id", "user_id", "stock_code", "trade_date"],
    "user_positions": ["user_id", "position_date", "stock_code"],
    "user_account_info": ["user_id", "info_date", "total_assets"],
}

UNIQUE_KEYS = {
    "stock_list": ["code"],
    "price_data": ["code", "day"],
    "indicator_data": ["code", "statDate"],
    "valuation_data": ["code", "day"],
    "user_transactions": ["trade_id"],
    "user_positions": ["user_id", "position_date", "stock_code"],
    "user_account_info": ["user_id", "info_date"],
}
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class RowRule:
    """Rows that meet ``bad`` are wrong; more than ``allowed`` of them make an issue."""

    table: str
    name: str
    category: str
    severity: str
    bad: Column | str               # a text is read as SQL
    description: str
    allowed: int = 0
    listed_only: bool = False       # judge rows inside the security's listing life only
    level: str = "quick"
    samples: tuple[str, ...] = ()   # columns shown for some of the bad rows

    def condition(self) -> Column:
        return F.expr(self.bad) if isinstance(self.bad, str) else self.bad


def _required(table: str, fields: Sequence[str], listed_only: bool = False,
              name: str = "required_fields_not_null") -> list[RowRule]:
    return [RowRule(table, f"{name}_{f}", "completeness", "critical", F.col(f).isNull(),
                    f"required field {f} is NULL", listed_only=listed_only) for f in fields]


def standard_rules(thresholds: Mapping | None = None, as_of: str = "9999-12-31") -> list[RowRule]:
    t = {**THRESHOLDS, **(thresholds or {})}
    tol, lim, since = t["financial_ratio_tolerance"], t["ratio_limit"], t["user_data_start_date"]
    shares = ("user_id", "position_date", "stock_code")
    trade = ("user_id", "trade_id", "stock_code")
    def accuracy(table: str, severity: str, name: str, bad: Column, description: str, **more) -> RowRule:
        return RowRule(table, name, "accuracy", severity, bad, description, **more)

    return [
        *_required("stock_list", ["code", "display_name", "start_date"]),
        accuracy("stock_list", "critical", "stock_code_format",
                 present("code") & ~has_known_suffix("code"),
                 "code without a known suffix"),
        accuracy("stock_list", "critical", "date_logic_validation",
                 F.datediff("end_date", "start_date") < 0, "delisted before listing"),
        accuracy("stock_list", "warning", "exchange_code_validation", ~F.col("exchange").isin(EXCHANGES),
                 "unknown exchange"),

        *_required("price_data", ["code", "day", "open", "high", "low", "close", "volume"],
                   listed_only=True),
        accuracy("price_data", "critical", "price_logic_validation", bar_clash(),
                 "high below low, or a negative value", listed_only=True, samples=("code", "day")),
        accuracy("price_data", "warning", "price_range_validation",
                 leaves_band("low", "high", "close", LIMITS["day_range_share"])
                 | outside("close", *LIMITS["close"]),
                 "price outside its plausible range", allowed=t["max_extreme_prices"] - 1,
                 listed_only=True),
        accuracy("price_data", "warning", "price_bracket_validation",
                 not_bracketed("low", "high", "open", "close"),
                 "open or close outside high and low", level="standard", samples=("code", "day")),

        accuracy("valuation_data", "warning", "valuation_ratios_reasonableness",
                 outside("pe_ratio", *LIMITS["pe_ratio"]) | outside("pb_ratio", *LIMITS["pb_ratio"])
                 | below_zero("market_cap"), "implausible valuation ratio",
                 allowed=t["max_extreme_valuations"] - 1, listed_only=True),

        accuracy("indicator_data", "warning", "financial_ratios_validation",
                 outside("eps", *LIMITS["eps"]) | outside("roe", -lim, lim) | outside("roa", -lim, lim),
                 "implausible financial ratio", allowed=t["max_invalid_ratios"] - 1),

        *_required("user_transactions", ["trade_id", "user_id", "stock_code", "trade_date",
                                         "trade_type"], name="required_fields_completeness"),
        accuracy("user_transactions", "critical", "trade_type_validation",
                 ~F.col("trade_type").isin(BUY, SELL), "neither buy nor sell", samples=trade),
        accuracy("user_transactions", "critical", "quantity_price_validation",
                 not_positive("quantity", "price"), "quantity or price not positive", samples=trade),
        accuracy("user_transactions", "warning", "amount_calculation_accuracy",
                 misstated_product("amount", "quantity", "price", tol),
                 "amount is not quantity times price", samples=trade),
        accuracy("user_transactions", "warning", "trade_date_validation",
                 F.col("trade_date") > as_day(as_of), "trade in the future", samples=trade),

        accuracy("user_positions", "critical", "position_quantity_logic", holding_clash(),
                 "quantities contradict each other", samples=shares),
        accuracy("user_positions", "warning", "market_value_calculation",
                 misstated_product("market_value", "position_quantity", "current_price", tol),
                 "market value is not quantity times price", samples=shares),

        accuracy("user_account_info", "warning", "asset_balance_check",
                 account_clash(LIMITS["asset_gap"]) & (F.col("info_date") >= as_day(since)),
                 "assets are not the sum of their parts", samples=("user_id", "info_date")),
        accuracy("user_account_info", "warning", "negative_amounts_check",
                 below_zero("total_assets", *CASH), "negative amount", samples=("user_id", "info_date")),
    ]


def statement_rules() -> list[RowRule]:
    """Assets equal liabilities plus equity within 1%."""
    share = gap_share("total_assets", "total_liability", "total_sheet_owner_equities")
    return [RowRule("balance_sheet", "statement_balance", "accuracy", "warning",
                    share > LIMITS["statement_gap_share"], "statement does not balance",
                    samples=("code", "stat_date"))]


def rules_at(level: str, rules: Sequence[RowRule]) -> list[RowRule]:
    """Quick runs leave out the rules of the standard level."""
    if level not in ("quick", "standard"):
        raise ValueError("level must be 'quick' or 'standard'")
    return [r for r in rules if level == "standard" or r.level == "quick"]


def judge_rows(df: DataFrame, rules: Sequence[RowRule], not_empty: bool = False,
               key_fields: Sequence[str] = (), null_warning: float = THRESHOLDS["null_ratio_warning"],
               null_critical: float = THRESHOLDS["null_ratio_critical"]) -> DataFrame:
    """Issues of one table from its row rules (all of one table and scope).

    ``not_empty`` adds the rule that there are rows at all, ``key_fields`` the shares of NULLs in them;
    all of it is one aggregate over one scan. Samples take a second scan, cut by rank before the shuffle.
    """
    spark, table = df.sparkSession, rules[0].table
    figures = [F.count_if(r.condition()).alias(r.name) for r in rules]
    about = [(r.name, r.category, r.severity, r.description, r.allowed, None) for r in rules]
    if not_empty:
        figures.append(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint")
                       .alias("table_not_empty"))
        about.append(("table_not_empty", "completeness", "critical", "the table has no rows", 0, None))
    for field in key_fields:
        figures.append(F.count_if(F.col(field).isNull()).alias(f"null_ratio_{field}"))
        about.append((f"null_ratio_{field}", "completeness", None, None, None, field))
    counts = df.agg(F.count(F.lit(1)).alias("total"), *figures) \
        .unpivot(["total"], [a[0] for a in about], "check_name", "n")
    # One row per rule: bounded by the rule list.
    meta = F.broadcast(spark.createDataFrame(
        about, "rule string, category string, severity string, description string, allowed bigint, field string"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total").cast("double"))
    found = counts.join(meta, F.col("check_name") == F.col("rule")).withColumn("share", share) \
        .filter(F.when(F.col("field").isNull(), F.col("n") > F.col("allowed"))
                .otherwise(F.col("share") > null_warning)) \
        .withColumn("severity", F.coalesce("severity", F.when(F.col("share") > null_critical, "critical")
                                           .otherwise("warning"))) \
        .withColumn("description", F.coalesce("description", F.concat(
            F.col("field"), F.lit(" is NULL in "), percent_text(F.col("share")), F.lit(" of rows"))))
    listing = [r for r in rules if r.samples]
    if listing:
        marks = F.array_compact(F.array(*[
            F.when(r.condition(), F.struct(F.lit(r.name).alias("sampled"),
                                           sample_text(r.samples).alias("text")))
            for r in listing]))
        exploded = df.select(F.explode(marks).alias("_m")).select("_m.*")
        found = found.join(first_samples(exploded, ["sampled"], F.col("text")),
                           F.col("check_name") == F.col("sampled"), "left")
    else:
        found = found.withColumn("samples", F.lit(None).cast("array<string>"))
    return found.select(
        "severity", "category", F.lit(table).alias("table_name"), "check_name", "description",
        F.col("n").alias("count"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
