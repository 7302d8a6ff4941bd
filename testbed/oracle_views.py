"""Shared views of the oracle statements, mirroring testbed.fixtures.

``with_views`` prefixes a statement with exactly the views it names.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["v_ticks"] = """
select series_key, t - t % 86400 as ws, t, t % 86400 as elapsed, event_id, value as spot,
  case when event_id % 37 = 0 then 0.0::double else cast(c as double) / 100 end as au,
  case when event_id % 37 = 0 then 0.0::double else cast(c - sp as double) / 100 end as bu,
  cast(100 - c + sp as double) / 100 as ad, cast(100 - c as double) / 100 as bd,
  5 + (event_id * 13) % 60 as su, 5 + (event_id * 17) % 60 as sau,
  5 + (event_id * 19) % 60 as sd, 5 + (event_id * 23) % 60 as sad
from (select *, (cast(floor(value * 100) as bigint) * 7 + event_id) % 91 + 5 as c,
             1 + event_id % 3 as sp
      from (select event_type as series_key, cast(floor(epoch(ts)) as bigint) as t, event_id, value,
                   row_number() over (partition by event_type, cast(floor(epoch(ts)) as bigint)
                                      order by event_id desc) as rn
            from events) e
      where rn = 1) d
"""

VIEWS["v_clean"] = """
select *, case when cand = 'Up' then au else ad end as cand_ask,
       case when cand = 'Up' then bu else bd end as cand_bid,
       case when cand = 'Up' then sau else sad end as cand_ask_size,
       case when cand = 'Up' then su else sd end as cand_bid_size,
       case when cand = 'Up' then ad else au end as fav_ask,
       case when cand = 'Up' then bd else bu end as fav_bid,
       case when cand = 'Up' then sad else sau end as fav_ask_size,
       case when cand = 'Up' then sd else su end as fav_bid_size
from (select *, case when ad is null then 'Up' when au is not null and au <= ad then 'Up'
                     else 'Down' end as cand
      from (select series_key, ws, t, elapsed, event_id, spot,
                   case when au > 0 then au end as au, case when bu > 0 then bu end as bu,
                   case when ad > 0 then ad end as ad, case when bd > 0 then bd end as bd,
                   su, sau, sd, sad from v_ticks) a) b
"""

VIEWS["v_windows"] = """
select series_key, ws, n as n_ticks,
  case when n < 2 or (ws // 86400) % 11 = 0 then null
       when lastv >= firstv then 'Up' else 'Down' end as outcome
from (select series_key, ws, count(*) as n, arg_max(spot, t) as lastv, arg_min(spot, t) as firstv
      from v_ticks group by series_key, ws) g
"""

VIEWS["v_bars"] = """
select series_key, t - t % 3600 as ts, arg_max(spot, t) as close from v_ticks group by 1, 2
"""

VIEWS["v_levels"] = """
select l_orderkey as asset, case when l_linenumber % 2 = 1 then 'ask' else 'bid' end as side,
  cast(floor(l_extendedprice * 100 / l_quantity) as bigint) as price_c,
  cast(sum(cast(l_quantity as bigint)) as bigint) as size
from lineitem group by 1, 2, 3
"""

VIEWS["v_fills"] = """
select l_orderkey as order_id, l_partkey as token_id,
  case when l_returnflag = 'A' then 'BUY' else 'SELL' end as side,
  cast(floor(l_extendedprice * 100 / l_quantity) / 100 as decimal(18,6)) as price,
  cast(l_quantity as decimal(18,6)) as size
from lineitem
"""

VIEWS["v_positions"] = """
select o_orderkey as position_id, o_custkey % 50 as series_id,
  cast(floor(epoch(o_orderdate)) as bigint) - cast(floor(epoch(o_orderdate)) as bigint) % 86400 as ws,
  case when o_orderkey % 2 = 0 then 'Up' else 'Down' end as side,
  case o_orderstatus when 'O' then 'open' when 'F' then 'settled' else 'closed' end as status,
  5 + o_orderkey % 40 as filled_size,
  cast((16 + o_orderkey % 14) * (5 + o_orderkey % 40) as double) as cost_c,
  (o_orderkey * 7) % 30 as fee_c, o_custkey as cust
from orders
"""

VIEWS["v_winners"] = """
select position_id, case cust % 3 when 0 then 'Up' when 1 then 'Down' end as winner from v_positions
"""

VIEWS["v_log"] = """
select line_id, dt, case when line_id % 97 = 0 then null else line_id % 5 end as kind_no,
  'a' || (line_id % 23) as asset_id, 'm' || (line_id % 7) as market, ts,
  (line_id % 89 + 10) / 100.0::double as p, (line_id % 79 + 10) / 100.0::double as q,
  case when line_id % 15 = 1 then 0.0::double else cast(line_id % 500 + 1 as double) end as s, (line_id // 5) % 2 = 0 as buy
from (select event_id as line_id, ts, strftime(ts, '%Y-%m-%d') as dt from events) e
"""

VIEWS["v_book"] = """
select line_id, dt, ts, 'book' as kind, asset_id, market, 'bid' as side, p as price, s as size from v_log where kind_no = 0
union all select line_id, dt, ts, 'book', asset_id, market, 'bid', 0.05::double, 7::double from v_log where kind_no = 0
union all select line_id, dt, ts, 'book', asset_id, market, 'ask', q, s from v_log where kind_no = 0
union all select line_id, dt, ts, 'pchange', asset_id, market, case when buy then 'bid' else 'ask' end, p, s from v_log where kind_no = 1
union all select line_id, dt, ts, 'restbook', asset_id, market, 'bid', p, s from v_log where kind_no = 2
union all select line_id, dt, ts, 'restbook', asset_id, market, 'ask', 0.96::double, s from v_log where kind_no = 2
union all select line_id, dt, ts, 'restbook', asset_id, market, 'ask', 0.97::double, 3::double from v_log where kind_no = 2
union all select line_id, dt, ts, 'trade', asset_id, market, 'BUY', p, s from v_log where kind_no = 3
"""

VIEWS["v_judge"] = """
select line_id, symbol, ws,
  case when line_id % 53 = 0 then 'maybe' when line_id % 2 = 0 then 'enter' else 'skip' end as action,
  case when line_id % 4 = 0 then [] else [vocab[line_id % 11 + 1],
       case when line_id % 31 = 0 then 'unregistered' else vocab[(line_id // 3) % 11 + 1] end] end as signals
from (select event_id as line_id, event_type as symbol,
        cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(ts)) as bigint) % 86400 as ws,
        ['vol_low','vol_high','trend_favor','feed_slow','spread_wide','depth_thin','cross_coin',
         'streak','session','intuition','news'] as vocab from events) e
"""

VIEWS["v_meta"] = """
select o_orderkey as market_id,
  case when o_orderkey % 7 = 6 then []::varchar[] when o_orderkey % 7 = 5 then ['Yes','No']
       when o_orderkey % 7 = 4 then ['DOWN','UP'] else ['Up','Down'] end as outcomes,
  case when o_orderkey % 11 = 10 then [o_orderkey || '0']
       else [o_orderkey || '0', o_orderkey || '1'] end as tokens,
  case o_orderkey % 5 when 0 then ['1','0'] when 1 then ['0','1'] when 2 then ['0.999','0.001']
       when 3 then ['0.45','0.55'] else []::varchar[] end as prices,
  o_orderkey % 13 <> 0 as active, o_orderkey % 3 = 0 as closed, o_orderkey % 4 = 0 as neg_risk,
  'c' || o_orderkey as condition_id,
  case when o_orderkey % 17 = 0 then 0.0::double else o_totalprice end as liquidity,
  o_totalprice * 2 as volume24hr
from orders
"""

VIEWS["v_candles"] = """
select series_key, ws, o, h, l, c, s >= cast(floor(o * 100 + 0.5) as bigint) * n as up_won
from (select series_key, ws, arg_min(spot, t) as o, max(spot) as h, min(spot) as l,
        arg_max(spot, t) as c, sum(cast(floor(spot * 100 + 0.5) as bigint)) as s, count(*) as n
      from v_ticks group by 1, 2) g
"""

VIEWS["v_changes"] = """
select o_custkey as cust, epoch(o_orderdate)::bigint as d, o_orderkey as k,
  case o_orderkey % 3 when 0 then ['slug','winner'] when 1 then ['pnl'] else ['winner','pnl'] end as changed,
  's' || o_orderkey as slug, case when o_orderkey % 5 = 0 then null else o_orderstatus end as winner,
  o_orderkey % 1000 - 500 as pnl
from orders
"""

VIEWS["v_twap_msg"] = """
select event_id as line_id, event_type || '/usd' as pair, cast(floor(epoch(ts)) as bigint) as t,
  event_id % 41 = 0 as pong, event_id % 41 <> 0 and event_id % 43 = 0 as broken,
  case when event_id % 3 = 0 or event_id % 7 = 3 then cast(floor(value * 100) as bigint) / 100.0::double
       else cast(cast(value as decimal(18,2)) as double) end as price
from events
"""

VIEWS["v_twap"] = "select line_id, pair, t, price from v_twap_msg where not pong and not broken"

VIEWS["v_intents"] = """
select o_orderkey as intent_id, cast(floor(epoch(o_orderdate)) as bigint) - cast(floor(epoch(o_orderdate)) as bigint) % 86400 as day_start,
  (o_orderkey % 60)::double / 10 as notional, o_orderkey % 29 = 0 as kill_switch,
  o_orderkey % 13 = 0 as same_window_open, (o_orderkey % 20)::double as invested_today,
  (o_orderkey % 23 - 12)::double as realized_today, o_orderkey % 2 = 0 as live,
  case when o_orderkey % 8 = 0 then null else (o_orderkey % 9)::double end as balance
from orders
"""

VIEWS["v_coverage"] = """
select ws, list(series_key) as found, (ws // 86400) % 5 = 0 as partial
from v_windows where (length(series_key) + ws // 86400) % 4 <> 0 group by ws
"""


def _needed(sql: str) -> set[str]:
    return set(re.findall(r"\bv_[a-z0-9_]+\b", sql)) & set(VIEWS)


def with_views(sql: str) -> str:
    """Prefix ``sql`` (a SELECT, or text starting with its own WITH) with the views it uses."""
    todo, needed = list(_needed(sql)), set()
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(_needed(VIEWS[name]))
    body = sql.strip().replace(", 6)", " + 1e-9, 6)")  # same nudge as testbed.fixtures.r6
    parts = [f"{name} as ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body


def view_order_is_sound() -> bool:
    """Every view only names views defined before it."""
    seen: set[str] = set()
    for name, sql in VIEWS.items():
        if not _needed(sql) <= seen:
            return False
        seen.add(name)
    return True
