"""Push-channel text frames: market data messages and TWAP updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = "array<struct<price:string,size:string>>"
_MESSAGE = ("struct<event_type:string,asset_id:string,market:string,side:string,price:string,size:string,"
            f"timestamp:string,hash:string,fee_rate_bps:string,bids:{_LEVEL},asks:{_LEVEL},"
            "changes:array<struct<side:string,price:string,size:string>>>")
_KINDS = {"book": "book", "price_change": "pchange", "last_trade_price": "trade"}


def _number(x: Column) -> Column:
    return x.try_cast("decimal(28,10)")


def split_frames(frames: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per message: a frame is one object or an array of them; bad JSON gives NULL ``m``."""
    body = F.trim(F.col(text))
    wrapped = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    parsed = F.from_json(wrapped, f"array<{_MESSAGE}>")
    return frames.select(*keep, F.explode_outer(parsed).alias("m"))


def _levels_ok(levels: Column) -> Column:
    return F.forall(F.coalesce(levels, F.array().cast(_LEVEL)),
                    lambda x: _number(x["price"]).isNotNull() & _number(x["size"]).isNotNull())


def _usable(m: Column) -> Column:
    kind = m["event_type"]
    has_asset = m["asset_id"].isNotNull()
    return (F.when(kind == "book", has_asset & _levels_ok(m["bids"]) & _levels_ok(m["asks"]))
            .when(kind == "price_change", has_asset & F.forall(
                F.coalesce(m["changes"], F.array().cast("array<struct<side:string,price:string,size:string>>")),
                _change_ok))
            .when(kind == "last_trade_price", has_asset & _number(m["price"]).isNotNull()
                  & (m["size"].isNull() | _number(m["size"]).isNotNull())))


def _change_ok(c: Column) -> Column:
    return c["side"].isNotNull() & _number(c["price"]).isNotNull() & _number(c["size"]).isNotNull()


def frame_counts(frames: DataFrame, text: str) -> DataFrame:
    """Messages, unknown types and malformed messages in one pass."""
    m = F.col("m")
    known = m["event_type"].isin(*_KINDS)
    bad = m.isNull() | (known & ~F.coalesce(_usable(m), F.lit(False)))
    return split_frames(frames, text).agg(
        F.count("*").alias("messages"),
        F.count_if(m.isNotNull() & ~F.coalesce(known, F.lit(False))).alias("unknown"),
        F.count_if(bad).alias("malformed"))


def parse_ws_frames(frames: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed event rows. Book messages keep their level arrays; changes become one row each.

    Changes listed before a malformed one in the same message still count, later ones do not.
    """
    m = F.col("m")
    no_levels = F.lit(None).cast("array<struct<price:decimal(28,10),size:decimal(28,10)>>")

    def event(kind: str, side: Column, price: Column, size: Column, bids=no_levels, asks=no_levels):
        return F.struct(
            F.lit(kind).alias("kind"), side.alias("side"), _number(price).alias("price"),
            _number(size).alias("size"), bids.alias("bids"), asks.alias("asks"))

    def levels(x: Column) -> Column:
        typed = F.transform(F.coalesce(x, F.array().cast(_LEVEL)), lambda v: F.struct(
            _number(v["price"]).alias("price"), _number(v["size"]).alias("size")))
        return typed

    none = F.lit(None).cast("string")
    changes = F.coalesce(m["changes"], F.array().cast("array<struct<side:string,price:string,size:string>>"))
    flags = F.transform(changes, lambda c: F.coalesce(_change_ok(c), F.lit(False)))
    first_bad = F.array_position(flags, False)
    usable_changes = F.when(first_bad > 0, F.slice(changes, F.lit(1), (first_bad - 1).cast("int"))).otherwise(changes)
    kind = m["event_type"]
    rows = (
        F.when((kind == "book") & _usable(m),
               F.array(event("book", none, none, none, levels(m["bids"]), levels(m["asks"]))))
        .when((kind == "price_change") & m["asset_id"].isNotNull(),
              F.transform(usable_changes, lambda c: event("pchange", c["side"], c["price"], c["size"])))
        .when((kind == "last_trade_price") & _usable(m),
              F.array(event("trade", F.coalesce(m["side"], F.lit("")), m["price"],
                            F.coalesce(m["size"], F.lit("0"))))))
    blank = lambda c: F.coalesce(m[c], F.lit("")).alias(c)
    return split_frames(frames, text, keep).select(
        *keep, m["asset_id"].alias("asset_id"), blank("market"), blank("timestamp"), blank("hash"),
        F.inline(rows))


def parse_twap_updates(messages: DataFrame, text: str, pair: str | None = None,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """TWAP updates: the 1e18 fixed-point value when present, else the display value.

    Non-JSON frames (heartbeats) are skipped; broken JSON rows come out with ``is_error``. With
    ``pair``, rows of other pairs are dropped before their values are looked at.
    """
    body = F.trim(F.col(text))
    parsed = F.from_json(
        body, "payload struct<symbol:string,value:string,full_accuracy_value:string>, _bad string",
        {"columnNameOfCorruptRecord": "_bad"})
    df = messages.filter(body.startswith("{")).withColumn("_p", parsed)
    bad_json = F.col("_p._bad").isNotNull()
    fixed, shown = F.col("_p.payload.full_accuracy_value"), F.col("_p.payload.value")
    exact = fixed.try_cast("decimal(38,0)") / F.lit(10 ** 18).cast("decimal(19,0)")
    price = F.when(fixed.isNotNull(), exact.cast("decimal(38,18)")).otherwise(
        shown.try_cast("decimal(38,18)"))
    has_value = fixed.isNotNull() | shown.isNotNull()
    if pair is not None:
        df = df.filter(bad_json | (F.col("_p.payload.symbol") == pair))
    out = df.select(*keep, F.col("_p.payload.symbol").alias("pair"), price.alias("price"),
                    (bad_json | (has_value & price.isNull())).alias("is_error"))
    return out.filter(F.col("is_error") | (F.col("pair").isNotNull() & F.col("price").isNotNull()))
