"""Security code expressions: dialects, exchange, board, names, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: code dialects and display names --------------------------
_TO_STANDARD_SUFFIX = {".XSHE": ".SZ", ".XSHG": ".SH", ".BSE": ".BJ", ".BJSE": ".BJ"}
_TO_VENDOR_SUFFIX = {".SZ": ".XSHE", ".SH": ".XSHG", ".BJ": ".BSE"}
_EXCHANGE_BY_SUFFIX = {".SH": "XSHG", ".SZ": "XSHE", ".BJ": "BSE"}
_BARE_SH = ("60", "68", "90")
_BARE_SZ = ("00", "30", "20")
_EXCHANGE_ALIASES = {"XSHG": "XSHG", "SSE": "XSHG", "SH": "XSHG",
                     "XSHE": "XSHE", "SZSE": "XSHE", "SZ": "XSHE",
                     "BSE": "BSE", "XBSE": "BSE", "BJSE": "BSE", "BJ": "BSE"}
_EXCHANGE_NAMES = {"XSHG": "上海证券交易所", "XSHE": "深圳证券交易所", "BSE": "北京证券交易所"}
_MARKET_NAMES = {"main": "主板", "gem": "创业板", "star": "科创板", "bse": "北交所"}
_TRADE_TYPE_NAMES = {23: "买入", 24: "卖出"}
_UNKNOWN_NAME = "未知"
# --- end of fixed values ----------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_suffix(code: Column, mapping: dict[str, str], otherwise: Column,
               keep_stem: bool = True) -> Column:
    out = None
    for old, new in mapping.items():
        hit = code.endswith(old)
        value = F.concat(_stem(code, old), F.lit(new)) if keep_stem else F.lit(new)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def _stem(code: Column, suffix: str) -> Column:
    return F.substring(code, F.lit(1), F.length(code) - F.lit(len(suffix)))


def _starts_with_any(code: Column, prefixes: tuple[str, ...]) -> Column:
    return F.substring(code, 1, len(prefixes[0])).isin(*prefixes)


def standard_code(c: Column | str) -> Column:
    """``.XSHE/.XSHG/.BSE/.BJSE`` and bare digits to ``.SZ/.SH/.BJ``; others unchanged."""
    code = _col(c)
    bare = (
        F.when(code.rlike("^[0-9]{4}$"), F.concat(code, F.lit(".BJ")))
        .when(code.rlike("^[0-9]{6}$") & _starts_with_any(code, _BARE_SH),
              F.concat(code, F.lit(".SH")))
        .when(code.rlike("^[0-9]{6}$") & _starts_with_any(code, _BARE_SZ),
              F.concat(code, F.lit(".SZ")))
        .otherwise(code)
    )
    return _by_suffix(code, _TO_STANDARD_SUFFIX, bare)


def vendor_code(c: Column | str) -> Column:
    """``.SZ/.SH/.BJ`` to ``.XSHE/.XSHG/.BSE``; others unchanged."""
    code = _col(c)
    return _by_suffix(code, _TO_VENDOR_SUFFIX, code)


def exchange_of(c: Column | str) -> Column:
    return _by_suffix(_col(c), _EXCHANGE_BY_SUFFIX, F.lit("UNKNOWN"), keep_stem=False)


def canonical_exchange(c: Column | str) -> Column:
    """Feeds spell exchanges in several ways; unknown spellings stay as they are."""
    return F.coalesce(_lookup(_EXCHANGE_ALIASES, F.upper(F.trim(_col(c)))), _col(c))


def market_of(c: Column | str) -> Column:
    """Board of a standard code: star and gem boards by number, otherwise main; Beijing bse."""
    code = _col(c)
    return (
        F.when(code.endswith(".BJ"), F.lit("bse"))
        .when(code.endswith(".SH"),
              F.when(code.startswith("688"), F.lit("star")).otherwise(F.lit("main")))
        .when(code.endswith(".SZ"),
              F.when(code.startswith("300"), F.lit("gem")).otherwise(F.lit("main")))
        .otherwise(F.lit("unknown"))
    )


def is_special_treatment(name: Column | str) -> Column:
    return F.coalesce(_col(name).contains("ST"), F.lit(False))


def has_known_suffix(c: Column | str, vendor_forms: bool = False) -> Column:
    code = _col(c)
    suffixes = list(_EXCHANGE_BY_SUFFIX) + ([".XSHG", ".XSHE", ".BSE"] if vendor_forms else [])
    out = F.lit(False)
    for s in suffixes:
        out = out | code.endswith(s)
    return F.coalesce(out, F.lit(False))


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def exchange_name(c: Column | str) -> Column:
    ex = _col(c)
    return F.coalesce(_lookup(_EXCHANGE_NAMES, ex), F.nullif(ex, F.lit("")),
                      F.lit(_UNKNOWN_NAME))


def market_name(c: Column | str) -> Column:
    m = _col(c)
    return F.coalesce(_lookup(_MARKET_NAMES, m), F.nullif(m, F.lit("")), F.lit(_UNKNOWN_NAME))


def trade_type_name(c: Column | str) -> Column:
    return F.coalesce(_lookup(_TRADE_TYPE_NAMES, _col(c).cast("int")), F.lit(_UNKNOWN_NAME))


def is_active(end_date: Column | str = "end_date", status: Column | str = "status") -> Column:
    """Never delisted and trading normally."""
    return _col(end_date).isNull() & F.coalesce(_col(status) == "normal", F.lit(False))


def is_index(security_type: Column | str = "security_type") -> Column:
    return F.coalesce(_col(security_type) == "index", F.lit(False))


def is_stock(security_type: Column | str = "security_type") -> Column:
    return F.coalesce(_col(security_type) == "stock", F.lit(False))


def in_exchange_scope(c: Column | str, scope: str) -> Column:
    """``bj``, ``sh``, ``sz``, ``sh_sz`` or ``all``."""
    code = _col(c)
    scopes = {
        "bj": code.endswith(".BJ"),
        "sh": code.endswith(".SH"),
        "sz": code.endswith(".SZ"),
        "sh_sz": code.endswith(".SH") | code.endswith(".SZ"),
        "all": F.lit(True),
    }
    if scope not in scopes:
        raise ValueError(f"unknown exchange scope {scope!r}; use one of {sorted(scopes)}")
    return scopes[scope]


def preferred_feed(c: Column | str, table: str = "price_data",
                   default: str = "primary", second: str = "secondary") -> Column:
    """Which landed feed serves a code: Beijing codes and daily basics the second one."""
    if table == "daily_basic":
        return F.lit(second)
    return F.when(_col(c).endswith(".BJ"), F.lit(second)).otherwise(F.lit(default))
