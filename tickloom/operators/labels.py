"""Study labels. The only module that reads rows after the current one.

Rule, feature and trigger modules must not import it; a test checks that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.functions.numeric import ten_dp
from tickloom.operators.asof import asof_ahead, backwards, ordered
from tickloom.operators.rolling import sliding_extreme

# Label horizons and the excursion horizon in seconds.
RETURN_AHEAD = (30, 60, 120)
EXCURSION = 60


def future_excursion(bid: Column, entry_ask: Column, keys: Sequence[str], time: str, horizon: int
                     ) -> tuple[Column, Column]:
    """Best and worst bid in (t, t+horizon] against the entry ask: (favourable, adverse)."""
    best, worst = _bids_ahead(bid, keys, time, horizon)
    return ten_dp(best - entry_ask), ten_dp(entry_ask - worst)


def _bids_ahead(bid: Column, keys: Sequence[str], time: str, horizon: int) -> tuple[Column, Column]:
    frame = (F.col(time), ordered(keys, time), backwards(keys, time), 1, horizon)
    return sliding_extreme(bid, *frame), sliding_extreme(bid, *frame, lowest=True)


def label_columns(ticks: DataFrame, keys: Sequence[str], *, time: str = "t",
                  outcome: str = "outcome", scale: int = 1, max_age: int = 5,
                  role: str = "cand", entry_ask: str = "cand_ask") -> DataFrame:
    """Forward returns, excursions and the final outcome for the candidate side.

    Mid and bid count only while both sides of that book have a price; a forward look that
    lands on an invalid row is NULL and does not fall back to an older one.
    """
    w, age = ordered(keys, time), max_age * scale
    both_up = F.col("au").isNotNull() & F.col("bu").isNotNull()
    both_down = F.col("ad").isNotNull() & F.col("bd").isNotNull()
    base = ticks.withColumns({
        "_mu": F.when(both_up, book.midpoint(F.col("au"), F.col("bu"))),
        "_md": F.when(both_down, book.midpoint(F.col("ad"), F.col("bd"))),
        "_bu": F.when(both_up, F.col("bu")), "_bd": F.when(both_down, F.col("bd")),
    })
    look = {}
    for side in ("u", "d"):
        for n in (0, *RETURN_AHEAD):
            look[f"_m{side}{n}"] = asof_ahead(F.col(f"_m{side}"), w, n * scale, age)
        look[f"_hi{side}"], look[f"_lo{side}"] = _bids_ahead(F.col(f"_b{side}"), keys, time, EXCURSION * scale)
    out = base.withColumns(look)

    pick = lambda stem, tail="": book.by_role(
        F.col(role), F.col(f"_{stem}u{tail}"), F.col(f"_{stem}d{tail}"))
    m0 = pick("m", "0")
    cols = {f"future_return_{n}": F.when(m0 > 0, ten_dp((pick("m", str(n)) - m0) / m0))
            for n in RETURN_AHEAD}
    cols["mfe_60"] = ten_dp(pick("hi") - F.col(entry_ask))
    cols["mae_60"] = ten_dp(F.col(entry_ask) - pick("lo"))
    cols["final_outcome"] = F.col(outcome)
    out = out.withColumns(cols)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
