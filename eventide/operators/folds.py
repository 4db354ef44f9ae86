"""Keyed sequential folds that no built-in window expresses: order books, debt episodes, prequential ranks.

Each fold runs over one key's rows in order (a trading day, a wallet), Arrow batches in, rows out; keys are
independent, so they spread over the cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame

#: What a change of the book means; codes of emitted rows.
BOOK_EVENTS = (
    "buy_market", "sell_market", "buy_inside", "sell_inside", "bid_add", "ask_add", "bid_fill", "ask_fill",
    "bid_remove", "ask_remove", "bid_cleared", "ask_cleared", "spread_widens", "spread_narrows", "bid_dominance", "ask_dominance", "mid_down",
)  # fixed values
_CODE = {n: i for i, n in enumerate(BOOK_EVENTS)}


class Side:
    """Live volume by price, with the best price kept sorted: bids by their negative."""

    def __init__(self, sign: int) -> None:
        self.sign, self.volume, self.order = sign, {}, []

    def set(self, price: int, volume: int) -> None:
        key = self.sign * price
        if volume > 0:
            if price not in self.volume:
                insort(self.order, key)
            self.volume[price] = volume
        elif self.volume.pop(price, None) is not None:
            del self.order[bisect_left(self.order, key)]

    def best(self) -> tuple[int | None, int]:
        price = self.sign * self.order[0] if self.order else None
        return price, self.volume.get(price, 0)

    def clear(self) -> None:
        self.volume.clear()
        self.order.clear()


def _book(rows: pd.DataFrame, begin: int | None = None, end: int | None = None) -> list[tuple[int, int, int]]:
    """(time, code, row) of every change, in order of arrival."""
    bid, ask, out = Side(-1), Side(1), []
    for k, (time, price, volume, side, kind, action) in enumerate(rows[["time", "price", "agg_volume", "side", "order_type", "action_type"]].itertuples(index=False, name=None)):
        mine = bid if side == 1 else ask
        buy = side == 1
        known = side in (1, 2, 5)
        (b0, bd0), (a0, ad0) = bid.best(), ask.best()
        best = b0 if buy else a0
        name = None
        if known and action == "A" and kind == "1":
            name = "buy_market" if buy else "sell_market"
        elif known and action == "A" and kind == "2" and best is not None:
            inside = price > best if buy else price < best
            name = ("buy_inside" if buy else "sell_inside") if inside else ("bid_add" if buy else "ask_add") if price == best else None
        elif known and action in ("M", "D") and price == best and best is not None:
            name = ("bid" if buy else "ask") + ("_fill" if action == "M" else "_remove")
        if action == "F":
            bid.clear()
            ask.clear()
        elif action in ("A", "M", "D", "Y") and price > 0 and known:
            mine.set(int(price), int(volume))
        (b1, bd1), (a1, ad1) = bid.best(), ask.best()
        if name in ("bid_remove", "ask_remove") and mine.best()[0] != best:
            name = "bid_cleared" if buy else "ask_cleared"
        names = [name] if name else []
        if b1 is not None and a1 is not None:
            if b0 is not None and a0 is not None:
                change = (a1 - b1) - (a0 - b0)
                names += ["spread_widens"] * (change > 0) + ["spread_narrows"] * (change < 0) + ["mid_down"] * (b1 + a1 < b0 + a0)
            was, now = (bd0 > ad0) - (bd0 < ad0), (bd1 > ad1) - (bd1 < ad1)
            names += ["bid_dominance"] * (now == 1 != was) + ["ask_dominance"] * (now == -1 != was)
        if (begin is None or time >= begin) and (end is None or time <= end):
            out += [(int(time), _CODE[n], k) for n in dict.fromkeys(names)]
    return out


def order_book(messages: DataFrame, key: str = "day") -> DataFrame:
    """key, time, code, row of book events; one key's messages fit in one task's memory."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time", "seq"], kind="stable")
        return pd.DataFrame([(rows[key].iloc[0], *x) for x in _book(rows)], columns=[key, "time", "code", "row"])

    kind = dict(messages.dtypes)[key]
    return messages.groupBy(key).applyInPandas(run, f"{key} {kind}, time bigint, code int, row bigint")


def _shocks(values: list[float], level: float) -> list[tuple[int, int]]:
    past, out = [], []
    for i in range(1, len(values)):
        d = values[i] - values[i - 1]
        if d:
            size = abs(d)
            larger = len(past) - bisect_left(past, size)
            if 1 + larger <= level * (len(past) + 1):
                out.append((i, 1 if d > 0 else -1))
            insort(past, size)
    return out


def prequential_fold(rows: DataFrame, level: float) -> DataFrame:
    """The same rows as signals.prequential_shocks(), with a sorted past per key instead of a range join."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        t = part["t"].tolist()
        return pd.DataFrame([(part["k"].iloc[0], t[i], s) for i, s in _shocks(part["v"].tolist(), level)], columns=["k", "t", "sign"])

    return rows.groupBy("k").applyInPandas(run, "k bigint, t bigint, sign int")


def _episodes(rows: pd.DataFrame) -> list[tuple]:
    """(episode, start, end, reason) of one wallet: opened by its first borrow, closed by liquidation or zero debt."""
    out, debt, start, number = [], {}, None, 0
    for kind, time, reserve, amount in rows[["kind", "time", "reserve", "amount"]].itertuples(index=False, name=None):
        if kind == "borrow":
            start = time if start is None else start
            debt[reserve] = debt.get(reserve, 0) + amount
        elif kind in ("repay", "liquidation") and start is not None:
            debt[reserve] = debt.get(reserve, 0) - amount
            if debt[reserve] <= 0:
                debt.pop(reserve)
            if kind == "liquidation" or not debt:
                out.append((number, int(start), int(time), "liquidated" if kind == "liquidation" else "repaid"))
                number, start = number + 1, None
                debt = {} if kind == "liquidation" else debt
    if start is not None:
        out.append((number, int(start), int(rows["time"].iloc[-1]), "open"))
    return out


def debt_episodes(actions: DataFrame) -> DataFrame:
    """owner, episode, start, end, reason of actions (owner, kind, time, seq, reserve, amount)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time", "seq"], kind="stable")
        return pd.DataFrame([(rows["owner"].iloc[0], *x) for x in _episodes(rows)], columns=["owner", "episode", "start", "end", "reason"])

    return actions.groupBy("owner").applyInPandas(run, "owner bigint, episode int, start bigint, end bigint, reason string")
