"""One core for batch and stream: an engine takes a state and rows and gives a state and rows.

Engines are plain Python and hold no Spark object. ``streamed`` runs one per key with Structured
Streaming's keyed state, ``replayed`` runs the same code over a finished table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Engine = Callable[[dict, list[dict]], tuple[dict, list[dict]]]

STEP_MS, CARRY_MS, GRACE_MS = 5_000, 15_000, 2_000


def _native(rows: pd.DataFrame) -> list[dict]:
    return [{k: (v.item() if hasattr(v, "item") else v) for k, v in r.items()} for r in rows.to_dict("records")]


def streamed(stream: DataFrame, key: str, order: Sequence[str], engine: Engine, schema: str) -> DataFrame:
    """``engine`` over each key of a stream; a key's rows of one micro-batch come in order. The state is kept as JSON."""
    names = [part.split()[0] for part in schema.split(",")]
    order = list(order)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        held = json.loads(state.get[0]) if state.exists else {}
        held, out = engine(held, _native(rows))
        state.update((json.dumps(held),))
        yield pd.DataFrame([{key: name[0], **r} for r in out], columns=names, dtype=object)

    return stream.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def replayed(rows: DataFrame, key: str, order: Sequence[str], engine: Engine, schema: str) -> DataFrame:
    """The same engine over a whole table, a key's rows at once."""
    names = [part.split()[0] for part in schema.split(",")]
    order = list(order)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, out = engine({}, _native(group.sort_values(order, kind="stable")))
        return pd.DataFrame([{key: group[key].iloc[0], **r} for r in out], columns=names, dtype=object)

    return rows.groupBy(key).applyInPandas(run, schema)


BUCKET_SCHEMA = "symbol string, boundary_ms long, open long, high long, low long, close long, qty long, trades long, status string, late long"


def buckets(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
    """Finalised 5-second buckets (boundary - 5 s, boundary] from trades (ms, id, price, qty).

    A boundary is final once a trade is seen 2 s past it. A trade of a final bucket is late: it is
    counted and dropped, never merged. An empty bucket carries the last price for up to 15 s
    (status CARRIED), else it is MISSING.
    """
    done, pending = state.get("done"), [tuple(p) for p in state.get("pending", [])]
    last, late, seen = state.get("last"), state.get("late", 0), state.get("seen", -(2**62))
    for r in rows:
        if done is None:
            done = (r["ms"] - 1) // STEP_MS * STEP_MS
        if r["ms"] <= done:
            late += 1
        else:
            pending.append((r["ms"], r["id"], r["price"], r["qty"]))
        seen = max(seen, r["ms"])
    out = []
    pending.sort()
    while done is not None and done + STEP_MS + GRACE_MS <= seen:
        done += STEP_MS
        own = [p for p in pending if p[0] <= done]
        pending = pending[len(own) :]
        if own:
            prices = [p[2] for p in own]
            last = [own[-1][0], prices[-1]]
            line = dict(open=prices[0], high=max(prices), low=min(prices), close=prices[-1], qty=sum(p[3] for p in own), trades=len(own), status="LIVE")
        else:
            carried = last is not None and done - last[0] <= CARRY_MS
            price = last[1] if carried else None
            line = dict(open=price, high=price, low=price, close=price, qty=0, trades=0, status="CARRIED" if carried else "MISSING")
        out.append({"boundary_ms": done, **line, "late": late})
    return {"done": done, "pending": pending, "last": last, "late": late, "seen": seen}, out


def ready(statuses: Sequence[str], windows: Sequence[int] = (25, 121, 361)) -> dict[int, bool]:
    """Which windows have their exact number of latest buckets, none missing."""
    return {n: len(statuses) >= n and "MISSING" not in statuses[-n:] for n in windows}


ALERT_SCHEMA = "symbol string, ms long, side int, baseline long, price long"


def alerts(threshold: float, cooldown_ms: int) -> Engine:
    """Cumulative baseline alerts: a move of ``threshold`` percent from the baseline, unless that direction is cooling down; an alert moves the baseline."""

    def engine(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        base, last, out = state.get("base"), dict(state.get("last", {})), []
        for r in rows:
            price = r["price"]
            if base is None:
                base = price
            elif abs(price - base) * 100 >= base * threshold:
                side = 1 if price > base else -1
                if r["ms"] - last.get(str(side), -(2**62)) >= cooldown_ms:
                    out.append(dict(ms=r["ms"], side=side, baseline=base, price=price))
                    base, last[str(side)] = price, r["ms"]
        return {"base": base, "last": last}, out

    return engine


EPISODE_SCHEMA = "market string, boundary_ms long, transition string, side int"


def episode_engine(start: int = 2, reverse: int = 2, end: int = 3) -> Engine:
    """The episode state machine over (boundary_ms, state, continues); a boundary seen before changes nothing."""
    sides = {"BROAD_RISE": 1, "BROAD_DROP": -1}

    def engine(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        side, pending, count, failed, at = (state.get(k, 0) for k in ("side", "pending", "count", "failed", "at"))
        out = []
        for r in rows:
            if r["boundary_ms"] <= at:
                continue
            at, now = r["boundary_ms"], sides.get(r["state"], 0)
            if r["state"] == "WARMING":
                if side:
                    out.append(dict(boundary_ms=at, transition="INTERRUPT", side=side))
                side = pending = count = failed = 0
                continue
            pending, count = (now, count + 1 if now == pending else 1) if now else (0, 0)
            if not side and now and count >= start:
                side, failed, count = now, 0, 0
                out.append(dict(boundary_ms=at, transition="START", side=side))
            elif side and now == -side and count >= reverse:
                side, failed, count = now, 0, 0
                out.append(dict(boundary_ms=at, transition="REVERSE", side=side))
            elif side and (now == side or r["continues"]):
                failed = 0
            elif side:
                failed += 1
                if failed >= end:
                    out.append(dict(boundary_ms=at, transition="END", side=side))
                    side = pending = count = failed = 0
        return {"side": side, "pending": pending, "count": count, "failed": failed, "at": at}, out

    return engine


def interrupted(state: dict) -> dict:
    """The state after a restart: no episode and nothing pending."""
    return {**state, "side": 0, "pending": 0, "count": 0, "failed": 0}


SIGMA_SCHEMA = "symbol string, ms long, variance string"


def variance_engine(half_life: int, least: int) -> Engine:
    """The exact EWMA block variance, carried from batch to batch; the same numbers as ``sequential.block_variance``. Written as text, as it may pass 64 bits."""
    lam = round(2 ** (-1 / half_life) * 2**40)

    def engine(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        a, w, n, before, last = (state.get(k) for k in ("a", "w", "n", "before", "last"))
        a, w, n = a or 0, w or 0, n or 0
        out = []
        for r in rows:
            price = r["price"]
            if price is not None and before:
                a = (lam * a >> 40) + (price - before) ** 2 * 10**20 // before**2
                w = (lam * w >> 40) + 2**40
                n += 1
                last = (a << 40) // w if n >= least else None
            before = price if price is not None else before
            out.append(dict(ms=r["ms"], variance=None if last is None else str(last)))
        return {"a": a, "w": w, "n": n, "before": before, "last": last}, out

    return engine


WALLET_SCHEMA = "account long, ms long, type string, id long, status string, amount long, balance long"


def wallet_engine(balance: int, risk_bp: int, most_positions: int) -> Engine:
    """The wallet's ledger, carried from batch to batch: balance and open positions are the state.

    Events of one time are taken by priority, so a batch must hold all events of its times.
    """
    from ..operators.sequential import PRIORITY

    def engine(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        now, held, out = state.get("balance", balance), dict(state.get("held", {})), []
        for e in sorted(rows, key=lambda e: (e["ms"], PRIORITY[e["type"]], e["id"])):
            amount, status, name = 0, "done", str(e["id"])
            if e["type"] == "open":
                if len(held) >= most_positions or now <= 0:
                    status = "rejected"
                else:
                    held[name] = now * risk_bp // 10_000
            elif name not in held:
                status = "ignored"
            else:
                amount = -held[name] if e["type"] == "liquidation" else held[name] * e["value"] // 1_000_000
                if e["type"] != "funding":
                    held.pop(name)
            now += amount
            out.append(dict(ms=e["ms"], type=e["type"], id=e["id"], status=status, amount=amount, balance=now))
        return {"balance": now, "held": held}, out

    return engine


def differing(ledger: DataFrame, start: int) -> DataFrame:
    """Per account the lines whose balance is not the start plus all amounts up to them; a sound ledger has none. ``ledger`` has a ``seq`` order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = ledger.withColumn("__sum", F.lit(start) + F.sum("amount").over(w))
    return rows.where("__sum <> balance").drop("__sum")
