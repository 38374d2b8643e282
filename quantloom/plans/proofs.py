"""SQL of queries whose recursions or states DuckDB tells by recursive common tables.

``PROOFS`` adds SQL to queries that other modules register. Each recursion runs along ``k``, the
place of a bar among its symbol's, from 1.
"""

from __future__ import annotations

from ..functions.calendar import DAY, HOUR
from .tables import FOUR_HOURLY, TRADES

BARS = "with recursive " + FOUR_HOURLY.removeprefix("with ") + """,
n as (select symbol, open_ms, open, high, low, close, row_number() over (partition by symbol order by open_ms) as k from bars)"""
_SCALE = 1 << 20


def wilder(name: str, values: str, n: int) -> str:
    """Exact Wilder averages of ``values`` (symbol, j, v), which are not negative."""
    return f"""{name}_seed as (select symbol, sum(v)::bigint * {_SCALE} // {n} as a from {values} where j <= {n} group by symbol having count(*) = {n}),
{name} as (select symbol, {n}::bigint as j, a::bigint as a from {name}_seed union all
  select x.symbol, x.j, (r.a * {n - 1} + x.v * {_SCALE}) // {n} from {name} r join {values} x on x.symbol = r.symbol and x.j = r.j + 1)"""


def ema(name: str, n: int) -> str:
    """Exact exponential averages of closes."""
    return f"""{name}_seed as (select symbol, sum(close)::bigint * {_SCALE} // {n} as e from n where k <= {n} group by symbol having count(*) = {n}),
{name} as (select symbol, {n}::bigint as k, e::bigint as e from {name}_seed union all
  select x.symbol, x.k, r.e + cast(floor((x.close * {_SCALE} - r.e) * 2 / {n + 1}.0) as bigint) from {name} r join n x on x.symbol = r.symbol and x.k = r.k + 1)"""


def walk(first: str, step: str, columns: str, given: str = "n") -> str:
    """A recursion ``r`` (symbol, k, columns) over ``given`` with ``x`` the new row and ``r`` the row before."""
    return f"""r({columns}) as (select symbol, k, {first} from {given} x where k = 1 union all
  select x.symbol, x.k, {step} from r join {given} x on x.symbol = r.symbol and x.k = r.k + 1)"""


_MOVES = "d as (select symbol, k, k - 1 as j, close - lag(close) over w as move, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as v from n window w as (partition by symbol order by k)), "
_RANGES = _MOVES + "tr as (select symbol, j, v::bigint as v from d where j > 0), "

PROOFS = {
    "wilder_atr": f"{BARS}, {_RANGES}{wilder('a', 'tr', 14)} select n.symbol, open_ms, case when n.k > 56 then a.a end as atr from n left join a on a.symbol = n.symbol and a.j = n.k - 1",
    "rsi_exact": f"""{BARS}, {_MOVES}up as (select symbol, j, greatest(move, 0)::bigint as v from d where j > 0), down as (select symbol, j, greatest(-move, 0)::bigint as v from d where j > 0),
{wilder('g', 'up', 14)}, {wilder('l', 'down', 14)}
select n.symbol, open_ms, case when n.k > 56 then g.a end as gain, case when n.k > 56 then l.a end as loss from n left join g on g.symbol = n.symbol and g.j = n.k - 1 left join l on l.symbol = n.symbol and l.j = n.k - 1""",
    "rsi": f"""{BARS}, {_MOVES}s as (select symbol, avg(greatest(move, 0))::double as g, avg(greatest(-move, 0))::double as l from d where j between 1 and 14 group by symbol having count(*) = 14),
r as (select symbol, 15::bigint as k, g, l from s union all select d.symbol, d.k, (r.g * 13 + greatest(d.move, 0)) / 14, (r.l * 13 + greatest(-d.move, 0)) / 14 from r join d on d.symbol = r.symbol and d.k = r.k + 1)
select n.symbol, open_ms, case when l = 0 then 100 when g = 0 then 0 else round(100 - 100 / (1 + g / l), 2) end as rsi from n left join r on r.symbol = n.symbol and r.k = n.k""",
    "macd": f"""{BARS}, {ema('fast', 12)}, {ema('slow', 26)},
line as (select f.symbol, f.k, f.k - 53 as j, f.e - s.e as v from fast f join slow s on s.symbol = f.symbol and s.k = f.k where f.k >= 54),
seed as (select symbol, cast(floor(sum(v) / 9.0) as bigint) as e from line where j <= 9 group by symbol having count(*) = 9),
sig as (select symbol, 9::bigint as j, e from seed union all select x.symbol, x.j, r.e + cast(floor((x.v - r.e) * 2 / 10.0) as bigint) from sig r join line x on x.symbol = r.symbol and x.j = r.j + 1)
select n.symbol, open_ms, line.v as line, case when sig.j >= 20 then sig.e end as signal from n left join line on line.symbol = n.symbol and line.k = n.k left join sig on sig.symbol = line.symbol and sig.j = line.j""",
    "adx": f"""{BARS}, m as (select symbol, k, k - 1 as j, high - lag(high) over w as u, lag(low) over w - low as d, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w))::double as tr from n window w as (partition by symbol order by k)),
v as (select symbol, k, j, tr, (case when u > d and u > 0 then u else 0 end)::double as u, (case when d > u and d > 0 then d else 0 end)::double as d from m where j > 0),
s as (select symbol, j, tr, u, d from v where j = 1 union all
  select v.symbol, v.j, case when v.j <= 14 then s.tr + v.tr else s.tr - s.tr / 14 + v.tr end, case when v.j <= 14 then s.u + v.u else s.u - s.u / 14 + v.u end, case when v.j <= 14 then s.d + v.d else s.d - s.d / 14 + v.d end
  from s join v on v.symbol = s.symbol and v.j = s.j + 1),
dx as (select symbol, j - 13 as i, case when tr = 0 or u + d = 0 then 0.0::double else 100 * abs(100 * u / tr - 100 * d / tr) / (100 * u / tr + 100 * d / tr) end as x from s where j >= 14),
seed as (select symbol, avg(x) as a from dx where i <= 14 group by symbol having count(*) = 14),
r as (select symbol, 14::bigint as i, a from seed union all select dx.symbol, dx.i, (r.a * 13 + dx.x) / 14 from r join dx on dx.symbol = r.symbol and dx.i = r.i + 1)
select n.symbol, open_ms, round(r.a, 6) as adx from n left join r on r.symbol = n.symbol and r.i = n.k - 14""",
    "channel_states": f"""{BARS}, t as (select *, max(close) over w as top, min(close) over w as bottom, (max(close) over w + min(close) over w) / 2.0 as middle from n window w as (partition by symbol order by k rows between 20 preceding and 1 preceding)),
{walk("0", "case when x.k <= 20 then 0 when x.close > x.top then 1 when x.close < x.bottom then -1 when r.state = 1 and x.close < x.middle then 0 when r.state = -1 and x.close > x.middle then 0 else r.state end", "symbol, k, state", "t")}
select n.symbol, open_ms, state from n join r on r.symbol = n.symbol and r.k = n.k""",
    "crossing_signals": f"""{BARS}, z as (select symbol, open_ms, k, case when k >= 20 then abs(z) end as a, z > 0 as up from (select *, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) as z from n window w as (partition by symbol order by k rows between 19 preceding and current row))),
f as (select *, a as b from z), {walk("true, x.a, null::bigint, 0", f"coalesce(x.a < 0.5, false) or (r.armed and not (r.armed and r.before is not null and coalesce(r.before < 1.5 and x.a >= 1.5, false) and (r.last is null or x.open_ms - r.last >= {DAY}))), x.a, case when r.armed and r.before is not null and coalesce(r.before < 1.5 and x.a >= 1.5, false) and (r.last is null or x.open_ms - r.last >= {DAY}) then x.open_ms else r.last end, case when r.armed and r.before is not null and coalesce(r.before < 1.5 and x.a >= 1.5, false) and (r.last is null or x.open_ms - r.last >= {DAY}) then case when x.up then 1 else -1 end else 0 end", "symbol, k, armed, before, last, signal", "f")}
select n.symbol, open_ms, signal from n join r on r.symbol = n.symbol and r.k = n.k""",
    "hysteresis_season": f"""{BARS}, u as (select symbol, k, case when k >= 6 and close >= avg(close) over (partition by symbol order by k rows between 5 preceding and current row) then 'up' else 'down' end as now from n),
{walk("x.now, null::varchar, 0", "case when x.now = r.label then r.label when x.now = r.waiting and r.held + 1 >= 3 then x.now else r.label end, case when x.now = r.label or (x.now = r.waiting and r.held + 1 >= 3) then null else x.now end, case when x.now = r.label or (x.now = r.waiting and r.held + 1 >= 3) then 0 when x.now = r.waiting then r.held + 1 else 1 end", "symbol, k, label, waiting, held", "u")}
select n.symbol, open_ms, label from n join r on r.symbol = n.symbol and r.k = n.k""",
    "no_trade_band": f"""{BARS}, t as (select symbol, k, close / (max(close) over (partition by symbol order by k))::double as target from n),
{walk("case when abs(x.target) > 0.1 then x.target else 0.0::double end", "case when abs(x.target - r.weight) > 0.1 then x.target else r.weight end", "symbol, k, weight", "t")}
select n.symbol, open_ms, round(weight, 9) as weight from n join r on r.symbol = n.symbol and r.k = n.k""",
    "ewma_std": f"""{BARS}, t as (select symbol, k, ln(close) - ln(lag(close) over (partition by symbol order by k)) as x from n),
{walk("0.0::double, 0.0::double, 0", "pow(0.5::double, 0.1::double) * r.s + x.x * x.x, pow(0.5::double, 0.1::double) * r.w + 1, r.n + 1", "symbol, k, s, w, n", "t")}
select n.symbol, open_ms, case when r.n >= 10 then round(sqrt(s / w), 9) end as std from n join r on r.symbol = n.symbol and r.k = n.k""",
    "baseline_alerts": f"""{BARS}, {walk("x.close, null::bigint, null::bigint, 0", ", ".join(
        f"case when abs(x.close - r.base) * 100 >= r.base * 30.0 and case when x.close > r.base then r.up is null or x.open_ms - r.up >= {2 * DAY} else r.down is null or x.open_ms - r.down >= {2 * DAY} end then {then} else {other} end"
        for then, other in (("x.close", "r.base"), ("case when x.close > r.base then x.open_ms else r.up end", "r.up"), ("case when x.close > r.base then r.down else x.open_ms end", "r.down"), ("case when x.close > r.base then 1 else -1 end", "0"))), "symbol, k, base, up, down, alert")}
select n.symbol, open_ms, alert from n join r on r.symbol = n.symbol and r.k = n.k""",
    "ewma_filter": f"""{BARS}, {walk("x.close::double", f"r.level + (1 - pow(2::double, {-4 * HOUR / DAY}::double)) * (x.close - r.level)", "symbol, k, level")}
select n.symbol, open_ms, round(level, 6) as level from n join r on r.symbol = n.symbol and r.k = n.k""",
    "kalman": f"""{BARS}, p(k, a, b, c) as (select 0::bigint, 1.0::double, 0.0::double, 1.0::double union all
  select k + 1, (a + 2 * b + c + 1) * (1 - (a + 2 * b + c + 1) / (a + 2 * b + c + 101)), (b + c) * (1 - (a + 2 * b + c + 1) / (a + 2 * b + c + 101)), c + 0.1 - (b + c) * (b + c) / (a + 2 * b + c + 101)
  from p where k < (select max(k) from n)),
gain as (select k + 1 as k, (a + 2 * b + c + 1) / (a + 2 * b + c + 101) as k0, (b + c) / (a + 2 * b + c + 101) as k1 from p),
g as (select n.symbol, n.k, close::double as x, k0, k1 from n join gain on gain.k = n.k),
{walk("x.x, 0.0::double", "r.level + r.slope + x.k0 * (x.x - r.level - r.slope), r.slope + x.k1 * (x.x - r.level - r.slope)", "symbol, k, level, slope", "g")}
select n.symbol, open_ms, round(level, 6) as level, round(slope, 6) as slope from n join r on r.symbol = n.symbol and r.k = n.k""",
    "greedy_independent": f"""with recursive {TRADES}, n as (select symbol, id, ms, ms + qty * 600000 as exit_ms, row_number() over (partition by symbol order by ms + qty * 600000, ms, id) as k from trades),
{walk("x.exit_ms, true", "case when x.ms > r.last then x.exit_ms else r.last end, x.ms > r.last", "symbol, k, last, taken")}
select n.symbol, id, ms, exit_ms, taken from n join r on r.symbol = n.symbol and r.k = n.k""",
    "fx_open_hours": f"with {TRADES}, t as (select id, ms, timezone('America/New_York', make_timestamptz(ms * 1000)) as l from trades) select id, ms, not (isodow(l) = 6 or (isodow(l) = 5 and hour(l) >= 17) or (isodow(l) = 7 and hour(l) < 17)) as is_open from t",
}
