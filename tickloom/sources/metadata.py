"""Market metadata: JSON-encoded list strings, alias columns, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source column -> our column.
ALIASES = {"conditionId": "condition_id", "negRisk": "neg_risk", "liquidityNum": "liquidity"}
LIST_COLUMNS = {"outcomes": "outcomes", "clobTokenIds": "tokens", "outcomePrices": "prices"}
DEFAULTS = {"active": True, "closed": False, "neg_risk": False, "liquidity": 0.0,
            "condition_id": ""}


def json_list(text: Column) -> Column:
    """JSON array of strings; text that is not an array becomes an empty list."""
    parsed = F.from_json(text, "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def decode_market_metadata(raw: DataFrame) -> DataFrame:
    out = raw.withColumns({src: json_list(F.col(src)) for src in LIST_COLUMNS if src in raw.columns})
    for src, dst in {**ALIASES, **LIST_COLUMNS}.items():
        if src in out.columns and src != dst:
            out = out.withColumnRenamed(src, dst)
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in out.columns}
    return out.withColumns(fills)
