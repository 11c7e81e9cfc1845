"""SQL that the exchange queries are held against, in another formulation where there is one.

``build`` puts the named views that a statement uses before it, each once and in order.
"""

from __future__ import annotations

import re


def rounded(raw: str, price: str, decimals: str) -> str:
    """raw * price / 10^(decimals + 10), half up, in parts that a hugeint holds: the whole of raw's money first, then the rest in billionths."""
    unit = f"cast(power(10::double, {decimals}) as hugeint)"
    # raw = whole * unit + rest, so the product is whole * price + rest * price / unit, in 10^-18; rest * price has 36 digits at most
    return f"(((({raw} // {unit}) * {price}) * 1000 + (({raw} % {unit}) * {price}) // ({unit} // 1000)) + 5000000000000) // 10000000000000"


VIEWS: dict[str, str] = {
    "ev": """
select event_id // 10 as block_number, event_id % 10 as log_index, cast(event_id as varchar) as tx_hash, ts as block_time,
  event_type as pool, cast(user_id as varchar) as recipient, value as price,
  case when k % 2 = 0 then -(k + 1) else k + 1 end as amount0, case when k % 2 = 0 then 2 * (k + 1) else -2 * (k + 1) end as amount1
from (select *, cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k from events)""",
    "sw": """
select cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as bigint) as block_number, log_index, cast(l_orderkey as varchar) as tx_hash,
  l_shipdate as block_time, p_brand as pool, cast(o_custkey % 100 as varchar) as sender, cast(l_suppkey as varchar) as recipient,
  case when l_returnflag = 'R' then 'sell' else 'buy' end as side,
  case when l_returnflag = 'R' then qty else -qty end as amount0, case when l_returnflag = 'R' then -cents else cents end as amount1,
  cast(split_part(p_brand, '#', 2) as bigint) as brand
from (select *, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as cents,
    row_number() over (partition by l_shipdate order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as log_index
  from lineitem) l join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "tr": "select recipient as wallet, pool as token, side, abs(amount0) as qty, abs(amount1) as value, block_number, log_index, tx_hash from sw",
    "ax": """
select *, coalesce(lag(b) over p, 0) as b0, coalesce(lag(c) over p, 0) as c0, coalesce(lag(u) over p, 0) as u0 from (
  select *, s - u as c from (
    select *, greatest(max(s - b) over (partition by wallet, token order by block_number, log_index rows unbounded preceding), 0) as u from (
      select *, cast(sum(case side when 'buy' then qty else 0 end) over w as bigint) as b, cast(sum(case side when 'sell' then qty else 0 end) over w as bigint) as s
      from tr window w as (partition by wallet, token order by block_number, log_index rows unbounded preceding))))
window p as (partition by wallet, token order by block_number, log_index)""",
    "pieces": """
select s.tx_hash as sell_tx, s.log_index as sell_log, s.block_number as sell_block, s.wallet, s.token, s.qty as sell_qty, s.value as sell_value,
  b.block_number as lot_block, b.log_index as lot_log, b.qty as lot_qty, b.value as lot_value, least(b.b, s.c) - greatest(b.b0, s.c0) as qty
from ax s join ax b on s.wallet = b.wallet and s.token = b.token and b.side = 'buy' and b.b > s.c0 and b.b0 < s.c
where s.side = 'sell' and s.c > s.c0
union all
select tx_hash, log_index, block_number, wallet, token, qty, value, block_number, null, null, null, u - u0 from ax where side = 'sell' and u > u0""",
    "cons": """
select *, proceeds - cost as realized from (
  select sell_tx, sell_log, cast(row_number() over (partition by wallet, token, sell_block, sell_log order by lot_log is null, lot_block, lot_log) - 1 as integer) as consume_seq,
    wallet, token, cast(qty as bigint) as qty, lot_block, lot_log, sell_block,
    cast((2 * cast(sell_value as hugeint) * qty * 1000000 + sell_qty) // (2 * sell_qty) as bigint) as proceeds,
    cast(coalesce((2 * cast(lot_value as hugeint) * qty * 1000000 + lot_qty) // (2 * lot_qty), 0) as bigint) as cost
  from pieces)""",
    "lots": """
select wallet, token, block_number as lot_block, log_index as lot_log, qty as lot_qty, value as lot_value, b - greatest(done, b0) as remaining,
  cast((2 * cast(value as hugeint) * (b - greatest(done, b0)) * 1000000 + qty) // (2 * qty) as bigint) as cost
from (select *, max(c) over (partition by wallet, token) as done from ax) where side = 'buy' and b > greatest(done, b0)""",
    "tot": """
select wallet, token, sell_tx, sell_block, sell_log, cast(sum(qty) as bigint) as qty, cast(sum(proceeds) as bigint) as proceeds,
  cast(sum(cost) as bigint) as cost, cast(sum(realized) as bigint) as realized
from cons group by wallet, token, sell_tx, sell_block, sell_log""",
    "stats": """
select a.wallet, coalesce(g.realized, 0) as realized, trades, coalesce(wins, 0) as wins, volume, volume // trades as avg_size, last_active_block
from (select wallet, count(*) as trades, cast(sum(value) as bigint) as volume, max(block_number) as last_active_block from tr group by wallet) a
left join (select wallet, cast(sum(realized) as bigint) as realized, count(*) filter (where realized > 0) as wins from tot group by wallet) g on a.wallet = g.wallet""",
    "own": "select recipient as wallet, count(*) as self_trades from sw where sender = recipient group by 1 having count(*) >= 10",
    "churn": """
select recipient as wallet, pool, count(*) as trades, cast(sum(amount0) as bigint) as net, cast(sum(abs(amount0)) as bigint) as gross
from sw group by 1, 2 having count(*) >= 24 and sum(abs(amount0)) > 0 and cast(abs(sum(amount0)) as double) < 0.02 * cast(sum(abs(amount0)) as double)""",
    "flagged": "select s.*, s.wallet in (select wallet from own union select wallet from churn) as excluded from stats s",
    "board": "select *, cast(row_number() over (order by realized desc, wallet) as integer) as rank from flagged where not excluded qualify rank <= 100",
    "c1": """
select pool, date_trunc('minute', block_time) as bucket, arg_min(price, block_number * 1048576 + log_index) as open, max(price) as high, min(price) as low,
  arg_max(price, block_number * 1048576 + log_index) as close, cast(sum(abs(amount0)) as bigint) as volume0, cast(sum(abs(amount1)) as bigint) as volume1, count(*) as trade_count
from ev group by 1, 2""",
    "ch": """
select pool, date_trunc('hour', block_time) as bucket, arg_min(price, block_number * 1048576 + log_index) as open, max(price) as high, min(price) as low,
  arg_max(price, block_number * 1048576 + log_index) as close, cast(sum(abs(amount0)) as bigint) as volume0, cast(sum(abs(amount1)) as bigint) as volume1, count(*) as trade_count
from ev where block_time < timestamp '2024-01-25 00:00:00' group by 1, 2""",
    "hd": "select number, md5('a' || number) as block_hash, md5('a' || (number - 1)) as parent_hash, block_time from (select block_number as number, min(block_time) as block_time from sw group by 1)",
    "can": """
select number, md5((case when number > 1200 then 'b' else 'a' end) || number) as block_hash,
  md5((case when number - 1 > 1200 then 'b' else 'a' end) || (number - 1)) as parent_hash from (select distinct block_number as number from sw)""",
    "pl": """
select p_brand as address, case when ends_with(p_brand, '1') then 'USDX' else p_brand end as token0, case when ends_with(p_brand, '2') then 'OTHER' else 'USD' end as token1
from (select distinct p_brand from part) where not ends_with(p_brand, '3')""",
    "val": """
select *, coalesce(sold_qty * case sold_token when 'USD' then 1 when 'USDX' then 100 end, bought_qty * case bought_token when 'USD' then 1 when 'USDX' then 100 end) as value,
  sold_token in ('USD', 'USDX') as sp, bought_token in ('USD', 'USDX') as bp
from (select sw.*, case when amount0 > 0 then token0 else token1 end as sold_token, case when amount0 > 0 then token1 else token0 end as bought_token,
    case when amount0 > 0 then abs(amount0) else abs(amount1) end as sold_qty, case when amount0 > 0 then abs(amount1) else abs(amount0) end as bought_qty
  from sw join pl on pool = address)""",
    "rc": """
select cast(block_time as date) + interval 1 day as available_at, arg_max(abs(amount1) / abs(amount0), log_index) as close from sw where pool = 'Brand#11' group by 1""",
    "vs": """
select *, case when sp is not null and bp is not null then 'money_for_money' when sp is not null then 'buy' when bp is not null then 'sell' else 'unpriceable' end as class,
  cast(coalesce(floor(coalesce(sold_whole * sp, bought_whole * bp) + 0.5), -1) as bigint) as value
from (
  select *, case sold when 'USD' then 100.0 when 'USDX' then 100.0 when 'OTHER' then usd end as sp, case bought when 'USD' then 100.0 when 'USDX' then 100.0 when 'OTHER' then usd end as bp
  from (
    select sw.* exclude (side), rc.close as usd, case when amount0 > 0 then token0 else token1 end as sold, case when amount0 > 0 then token1 else token0 end as bought,
      case when amount0 > 0 then abs(amount0) else abs(amount1) / 100 end as sold_whole, case when amount0 > 0 then abs(amount1) / 100 else abs(amount0) end as bought_whole
    from sw join pl on pool = address asof left join rc on block_time >= available_at))""",
    "ve": """
select *, case when sp and bp then 'money_for_money' when sp then 'buy' when bp then 'sell' else 'unpriceable' end as class,
  cast(case when sp then {round_sold} when bp then {round_bought} end as decimal(38,0)) * cast(0.00000001 as decimal(8,8)) as value
from (
  select *, sold in ('USD', 'USDX') as sp, bought in ('USD', 'USDX') as bp,
    case sold when 'USD' then 999987654321012345::hugeint when 'USDX' then 1000000000000000001::hugeint end as ps,
    case bought when 'USD' then 999987654321012345::hugeint when 'USDX' then 1000000000000000001::hugeint end as pb
  from (
    select * exclude (side), case when raw0 > 0 then token0 else token1 end as sold, case when raw0 > 0 then token1 else token0 end as bought,
      case when raw0 > 0 then abs(raw0) else abs(raw1) end as sold_qty, case when raw0 > 0 then abs(raw1) else abs(raw0) end as bought_qty,
      case when raw0 > 0 then 18 else 6 end as sold_decimals, case when raw0 > 0 then 6 else 18 end as bought_decimals
    from (
      select *, (case when log_index % 50 = 49 then 0 else abs(amount0)::hugeint * 1000000000000000000 end + log_index::hugeint * 123456789123 + 1) * sign(amount0) as raw0,
        case when log_index % 50 = 49 then sign(amount1) * (1 + log_index % 3) else amount1 * 10000 end::hugeint as raw1
      from sw join pl on pool = address)))""".replace("{round_sold}", rounded("sold_qty", "ps", "sold_decimals")).replace("{round_bought}", rounded("bought_qty", "pb", "bought_decimals")),
    "wt": "select recipient as wallet, case class when 'buy' then bought else sold end as token, class as side, case class when 'buy' then bought_qty else sold_qty end as qty, value, block_number, log_index, tx_hash from ve where class in ('buy', 'sell')",
    "wx": """
select *, coalesce(lag(b) over p, 0) as b0 from (
  select *, s - greatest(max(s - b) over (partition by wallet, token order by block_number, log_index rows unbounded preceding), 0) as c from (
    select *, sum(case side when 'buy' then qty else 0 end) over w as b, sum(case side when 'sell' then qty else 0 end) over w as s
    from wt window w as (partition by wallet, token order by block_number, log_index rows unbounded preceding)))
window p as (partition by wallet, token order by block_number, log_index)""",
    "np": """
select pool as address, min(block_time) as discovered_at, min(block_number) as created_block, any_value(brand) % 2 = 0 as is_indexed,
  case any_value(brand) % 3 when 0 then 'fresh,no_liquidity' when 1 then 'fresh,single_lp' else 'fresh' end as risk_flags from sw group by 1""",
    "watched": "select distinct recipient as wallet from sw where cast(recipient as bigint) <= 30",
    "days": "select cast(block_time as date) as day, max(block_number) as max_block, count(*) as rows from sw group by 1",
}

CANDLE = "pool, epoch(bucket)::bigint as bucket, open, high, low, close, volume0, volume1, trade_count"


def candle(rows: str, unit: str) -> str:
    return f"""select pool, epoch(date_trunc('{unit}', block_time))::bigint as bucket, arg_min(price, block_number * 1048576 + log_index) as open, max(price) as high,
  min(price) as low, arg_max(price, block_number * 1048576 + log_index) as close, cast(sum(abs(amount0)) as bigint) as volume0,
  cast(sum(abs(amount1)) as bigint) as volume1, count(*) as trade_count from ({rows}) group by 1, 2"""


#: Trades of positions that priced swaps make, in the place of tr.
POSITIONS = {
    "tr": "select recipient as wallet, case class when 'buy' then bought else sold end as token, class as side, abs(amount0) as qty, value, block_number, log_index, tx_hash from vs where class in ('buy', 'sell')"
}


#: One position that holds a third of all trades, in the place of tr.
HOT_POSITION = {
    "tr": """select case when log_index % 3 = 0 then 'hot' else recipient end as wallet, case when log_index % 3 = 0 then 'hot' else pool end as token,
  side, abs(amount0) as qty, abs(amount1) as value, block_number, log_index, tx_hash from sw"""
}

#: Trades, volume and what is held of wallets with wide positions.
WIDE_CARDS = """select a.*, coalesce(h.positions, 0) as positions, coalesce(h.held, 0) as held from (
  select wallet, count(*) as trades, sum(value) as volume, max(block_number) as last_active_block from wt group by 1) a
left join (select wallet, count(distinct token) as positions, sum(remaining) as held from (
  select wallet, token, cast(b as hugeint) - greatest(done, b0) as remaining from (select *, max(c) over (partition by wallet, token) as done from wx)
  where side = 'buy' and b > greatest(done, b0)) group by 1) h on a.wallet = h.wallet"""


def build(statement: str, own: dict[str, str] | None = None) -> str:
    used: list[str] = []
    views = VIEWS | (own or {})

    def add(text: str) -> None:
        for name in views:
            if re.search(rf"\b(?:from|join)\s*\(?\s*{name}\b", text) and name not in used:
                add(views[name])
                used.append(name)

    add(statement)
    return f"with {', '.join(f'{n} as ({views[n].strip()})' for n in used)}\n{statement.strip()}" if used else statement


def clean_run(fork: int) -> dict[str, str]:
    """Views of the trades up to a fork, under the names of those of all trades."""
    return {"tr": VIEWS["tr"] + f" where block_number <= {fork}"}


def rebuilt(statement: str, fork: int) -> str:
    """The statement over a clean run up to the fork."""
    return build(statement).replace(VIEWS["tr"], clean_run(fork)["tr"])
