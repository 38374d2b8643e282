"""Fills, fees, funding, margins and liquidation as column expressions on doubles.

``side`` is 1 for a long and -1 for a short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Fixed values of cost model v1."""

    taker: float = 0.0005
    maker: float = 0.0002
    market_floor: float = 0.0001
    market_range: float = 1 / 10
    stop_floor: float = 0.0002
    stop_range: float = 1 / 4
    liquidation_fee: float = 1 / 80
    mmr: float = 0.01
    leverage_cap: int = 20
    buffer: float = 3.0
    multiplier: float = 1.0
    funding: float = 1.0


V1 = Costs()


def market_slippage(open_: Column, high: Column, low: Column, c: Costs = V1) -> Column:
    return F.greatest(open_ * c.market_floor, (high - low) * c.market_range) * c.multiplier


def stop_slippage(open_: Column, high: Column, low: Column, c: Costs = V1) -> Column:
    return F.greatest(open_ * c.stop_floor, (high - low) * c.stop_range) * c.multiplier


def entry_fill(side: Column, open_: Column, high: Column, low: Column, c: Costs = V1) -> Column:
    return open_ + side * market_slippage(open_, high, low, c)


def stop_fill(side: Column, stop: Column, open_: Column, high: Column, low: Column, c: Costs = V1) -> Column:
    """The worse of stop and open, and slippage."""
    slip = stop_slippage(open_, high, low, c)
    return F.when(side > 0, F.least(stop, open_) - slip).otherwise(F.greatest(stop, open_) + slip)


def fee(price: Column, rate: float, c: Costs = V1) -> Column:
    return price * rate * c.multiplier


def funding_cash(side: Column, mark: Column, rate: Column, c: Costs = V1) -> Column:
    """Positive: received."""
    return -side * mark * rate * c.funding


def liquidation_price(side: Column, entry: Column, leverage: Column, mmr: float = V1.mmr, cum: float = 0.0) -> Column:
    return (entry / leverage + cum - side * entry) / (mmr - side)


def max_leverage(side: Column, entry: Column, stop_distance: Column, c: Costs = V1) -> Column:
    """The highest leverage whose liquidation is ``buffer`` stop distances away; null if not even 1 is."""
    need = c.mmr + c.buffer * stop_distance * (1 - side * c.mmr) / entry
    out = F.least(F.lit(c.leverage_cap), F.floor(1 / need).cast("int"))
    return F.when(out >= 1, out)


def liquidation_loss(side: Column, entry: Column, price: Column, leverage: Column, c: Costs = V1) -> Column:
    """Per unit, with the fee, at most the margin."""
    return F.least(side * (entry - price) + c.liquidation_fee * price * c.multiplier, entry / leverage)


def net_at(net: Column, cost: Column, wallet: Column, multiplier: float) -> Column:
    """Micro-R at a multiple of the costs, not below the loss of the wallet."""
    return F.greatest(-wallet, net + (1 - multiplier) * cost)


# -- futures accounts


def unrealized(side: Column, quantity: Column, entry: Column, mark: Column) -> Column:
    return side * quantity * (mark - entry)


def increased(quantity: Column, entry: Column, added: Column, fill: Column) -> tuple[Column, Column]:
    """(quantity, average entry) after adding."""
    total = quantity + added
    return total, (quantity * entry + added * fill) / total


def reduced(side: Column, quantity: Column, entry: Column, closed: Column, fill: Column) -> tuple[Column, Column]:
    """(quantity, realized) after closing part."""
    return quantity - closed, side * closed * (fill - entry)


def maintenance(notional: Column, rate: Column, cum: Column) -> Column:
    return notional * rate - cum


def bracket_liquidation(side: Column, quantity: Column, entry: Column, collateral: Column, mmr: Column, cum: Column) -> Column:
    """The price at which equity is the bracket's maintenance margin."""
    return (side * quantity * entry - collateral - cum) / (quantity * (side - mmr))


# -- lattices and orders


def off_grid(value: Column, least: Column, step: Column) -> Column:
    """Of integers: not ``least`` plus a multiple of ``step``."""
    return F.pmod(value - least, step) != 0


def grid_reasons(value: Column, least: Column, most: Column, step: Column) -> Column:
    return F.array_compact(
        F.array(F.when(value < least, F.lit("BELOW_MINIMUM")), F.when(value > most, F.lit("ABOVE_MAXIMUM")), F.when(off_grid(value, least, step), F.lit("OFF_GRID")))
    )


def suggested(value: Column, least: Column, step: Column, up: bool = False) -> Column:
    """The nearest lattice value below, or above."""
    steps = (value - least) / step
    return least + (F.ceil(steps) if up else F.floor(steps)) * step


# -- foreign exchange


@dataclass(frozen=True)
class FxCosts:
    market_spread: float = 0.25
    market_range: float = 0.05
    stop_spread: float = 0.5
    stop_range: float = 0.1
    commission: float = 3.5
    stop_out: float = 0.5
    buffer: float = 3.0
    leverage_cap: int = 30


FX = FxCosts()


def fx_entry_reference(side: Column, bid: Column, spread: Column) -> Column:
    """A long buys at the ask, a short sells at the bid."""
    return F.when(side > 0, bid + spread).otherwise(bid)


def fx_exit_reference(side: Column, bid: Column, spread: Column) -> Column:
    return F.when(side > 0, bid).otherwise(bid + spread)


def fx_stop_hit(side: Column, stop: Column, spread: Column, high: Column, low: Column) -> Column:
    return F.when(side > 0, low <= stop).otherwise(high + spread >= stop)


def fx_target_hit(side: Column, target: Column, spread: Column, high: Column, low: Column) -> Column:
    return F.when(side > 0, high >= target).otherwise(low + spread <= target)


def fx_stop_fill(side: Column, stop: Column, bid_open: Column, spread: Column, high: Column, low: Column, c: FxCosts = FX) -> Column:
    slip = F.greatest(spread * c.stop_spread, (high - low) * c.stop_range)
    return F.when(side > 0, F.least(stop, bid_open) - slip).otherwise(F.greatest(stop, bid_open + spread) + slip)


def fx_units(risk: Column, distance: Column, rate: Column, contract: float, lot_step: float, min_lot: float) -> Column:
    """Base units for a risk, floored to the lot step; null below the least lot."""
    step = contract * lot_step
    units = F.floor(risk / (distance * rate) / step) * step
    return F.when(units >= min_lot * contract, units)


def fx_stop_out(side: Column, fill: Column, leverage: Column, c: FxCosts = FX) -> Column:
    return fill - side * fill * (1 - c.stop_out) / leverage


def fx_swap(side: Column, units: Column, multiplier: Column, long_rate: Column, short_rate: Column) -> Column:
    return units * F.when(side > 0, long_rate).otherwise(short_rate) * multiplier


def fx_max_leverage(fill: Column, distance: Column, c: FxCosts = FX) -> Column:
    out = F.least(F.floor(fill * (1 - c.stop_out) / (c.buffer * distance)).cast("int"), F.lit(c.leverage_cap))
    return F.when(out >= 1, out)
