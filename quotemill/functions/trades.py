"""Trade and position expressions: ids, strategy tags, fees, marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill.functions.dates import compact_date
from quotemill.schemas import BUY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strategy_from_prefix(remark: Column | str) -> Column:
    """Text before the first underscore: ``str1001_600335.SH`` -> ``str1001``."""
    return F.nullif(F.regexp_extract(_col(remark), r"^([^_]+)_", 1), F.lit(""))


def strategy_from_tag(remark: Column | str) -> Column:
    """Text after ``strategy_id:`` up to the next such tag."""
    r = _col(remark)
    return F.when(r.contains("strategy_id:"),
                  F.trim(F.get(F.split(r, "strategy_id:"), F.lit(1))))


def generated_trade_id(user: Column | str, *parts: Column | str) -> Column:
    """Stable id for a trade that came without one, from its own values."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("")) for p in (user, *parts)]
    return F.concat_ws("_", _col(user), F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 24))


def position_id(user: Column | str, day: Column | str, code: Column | str) -> Column:
    return F.concat_ws("_", F.lit("POS"), _col(user), compact_date(day), _col(code))


def net_amount(trade_type: Column | str, amount: Column | str, *fees: Column | str) -> Column:
    """Cash moved: a buy pays the fees on top, anything else has them taken off."""
    total = _col(fees[0])
    for f in fees[1:]:
        total = total + _col(f)
    return F.when(_col(trade_type) == BUY, _col(amount) + total).otherwise(_col(amount) - total)


def mark_price(quantity: Column, value: Column) -> Column:
    """Price implied by a holding's value; NULL unless both are positive."""
    return F.when((quantity > 0) & (value > 0), F.try_divide(value, quantity))


def unrealized_pnl(quantity: Column, open_price: Column, value: Column,
                   current_price: Column) -> Column:
    return F.when((current_price > 0) & (open_price > 0), value - open_price * quantity)


def pnl_ratio(pnl: Column, quantity: Column, open_price: Column) -> Column:
    cost = open_price * quantity
    return F.when(cost > 0, F.try_divide(pnl, cost))
