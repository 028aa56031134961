"""Market columns: boards, auction repair, limits, lots, costs, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Auction factors by board (fixed values).
AUCTION_FACTORS = {"sz_main_00": 0.76, "sz_gem_30": 0.58}
#: Unit conversions (fixed values).
UNITS = {"hands": 100.0, "thousands": 1000.0, "percent": 0.01, "ten_thousands": 10000.0}
PRICE_TOLERANCE, RELATIVE_TOLERANCE = 0.005, 1e-9


def bucket(code: str) -> Column:
    c = F.upper(F.trim(F.col(code)))
    sz, sh = c.endswith(".SZ"), c.endswith(".SH")
    return F.when(sz & c.startswith("00"), "sz_main_00").when(sz & c.startswith("30"), "sz_gem_30").when(sh & c.startswith("60"), "sh_main_60").when(sh & c.startswith("68"), "sh_star_68").when(c.endswith(".BJ"), "bj").otherwise("other")


def security_type(code: str) -> Column:
    c = F.col(code)
    return F.when(c.endswith(".BJ"), "BJ").when(c.rlike(r"^(200|900)"), "B_share").when(c.rlike(r"^(15|16|50|51|56|58)"), "fund").when(c.rlike(r"^(00|30|60|68)"), "A_share").otherwise(F.split_part(c, F.lit("."), F.lit(-1)))


def open_auction_correction(bars: DataFrame, code: str = "ts_code", time: str = "trade_time") -> DataFrame:
    """Adds ``vol_pit``, ``amount_pit``, ``auction_factor`` and ``auction_rule``; only bars of the opening auction change."""
    factor = F.lit(1.0)
    for name, f in AUCTION_FACTORS.items():
        factor = F.when(F.col(time).contains("09:30") & (bucket(code) == name), F.lit(f)).otherwise(factor)
    out = bars.withColumn("auction_factor", factor)
    return out.select("*", (F.col("vol") * F.col("auction_factor")).alias("vol_pit"), (F.col("amount") * F.col("auction_factor")).alias("amount_pit"), F.when(F.col("auction_factor") < 1, "factor").otherwise("none").alias("auction_rule"))


def auction_price_repair(rows: DataFrame) -> DataFrame:
    """Drops rows without price, vol and amount; ``auction_state`` is traded, recovered, no_trade or bad, and prices follow it."""
    p, v, a = F.col("price"), F.col("vol"), F.col("amount")
    traded = (v > 0) & (a > 0)
    implied = a / v
    near = F.abs(p - implied) <= PRICE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(implied)
    state = F.when(traded & p.isNull(), "recovered").when(traded & near, "traded").when((v == 0) & (a == 0), "no_trade").otherwise("bad")
    kept = rows.where(~(p.isNull() & v.isNull() & a.isNull())).withColumn("auction_state", state)
    return kept.withColumn("price", F.when(F.col("auction_state") == "recovered", implied).when(F.col("auction_state") == "no_trade", None).otherwise(p))


def ohlc_fill(bars: DataFrame) -> DataFrame:
    opened = bars.withColumn("open", F.coalesce("open", "close"))
    return opened.withColumn("high", F.coalesce("high", F.greatest("open", "close"))).withColumn("low", F.coalesce("low", F.least("open", "close")))


def limit_flags(price: Column, up: Column, down: Column) -> dict[str, Column]:
    """Whether the price sits at a limit, and the price clamped to the band; a null limit is no limit."""
    return {"up": F.coalesce(price >= up, F.lit(False)), "down": F.coalesce(price <= down, F.lit(False)), "clamped": F.greatest(F.least(price, up), down)}


def lot_reject(shares: Column, sellable: Column, board: Column, selling: Column) -> Column:
    """Why an order's size is not allowed, else null: whole hundreds, or from 200 (STAR) or 100 (BJ) on by ones; a sale may clear an odd rest at once."""
    clears = selling & (shares == sellable)
    plain = F.when((shares % 100 != 0) & ~clears, "odd_lot")
    least = lambda n: F.when((shares < n) & ~clears, "below_minimum")
    return F.when(shares <= 0, "not_positive").when(board == "sh_star_68", least(200)).when(board == "bj", least(100)).otherwise(plain)


def trade_costs(notional: Column, selling: Column, duty: Column, rate: float = 0.0003, least: float = 5.0, transfer: float = 0.00001) -> dict[str, Column]:
    commission, moved = F.greatest(notional * rate, F.lit(least)), notional * transfer
    stamp = F.when(selling, notional * duty).otherwise(0.0)
    return {"commission": commission, "transfer": moved, "stamp": stamp, "cash": F.when(selling, notional).otherwise(-notional) - commission - moved - stamp}


def unit_normalize(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Multiplies each listed column, as a number, by its unit's factor; text that is no number is null."""
    return df.withColumns({c: F.col(c).try_cast("double") * UNITS[u] for c, u in units.items() if c in df.columns})
