"""All queries of the exchange analytics, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexspark.functions.columns import address_text, event_key, price_from_sqrt
from dexspark.functions.wide import limbs, to_text
from dexspark.operators import alerts, candles, chain, decode, discovery, fifo, pages, quality, retention, revert, trades, wallets
from dexspark.operators import hot as hot_positions
from dexspark.plans import sql, views
from dexspark.sources import logs
from dexspark.sources.shared import shared_path, stored, tidy
from dexspark.sources.tables import Folder, Snapshots, append_new, merge_add, upsert
from dexspark.streaming import book, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Parameters of the queries.
EVENT_FORK, FLOOR, AS_OF = 600, "2024-01-10 00:00:00", "2024-01-25 00:00:00"
FORK, FINAL, HEAD = 1200, 1100, 1200
WASH = {"self_least": 10, "churn_least": 24, "ratio": 0.02}
POOL, WALLET, USER_POOL = "Brand#11", "7", "purchase"
DAY = 86_400
TICKS = (900, 1050, 1200)

# SQL of the encoded logs: those of liquidity, and all; brand 0 stands for the factory.
LIQUIDITY = """select *, 'mint' as kind, 100000 as shift from sw where cast(sender as bigint) < brand % 3
  union all select *, 'burn', 200000 from sw where sender = '50' union all select *, 'collect', 300000 from sw where sender = '51'"""
ALL_LOGS = f"""select block_number, tx_hash, cast(log_index as integer) as log_index, brand from sw
  union all select block_number, tx_hash, cast(log_index + shift as integer), brand from ({LIQUIDITY})
  union all select min(block_number), 'c' || brand, cast(400000 + brand as integer), 0 from sw group by brand"""


def query(statement: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = sql.build(statement) if "with " != statement[:5] else statement
        return f

    return add


def moment(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def flat(rows: DataFrame) -> DataFrame:
    """Candles with plain types."""
    return rows.select("pool", F.unix_timestamp("bucket").alias("bucket"), "open", "high", "low", "close", F.col("volume0").cast("long").alias("volume0"), F.col("volume1").cast("long").alias("volume1"), "trade_count")


def position_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.position_trades(views.swaps(spark, sf_dir))


# Candles


@query(f"select {sql.CANDLE} from c1")
def candles_1m(spark, sf_dir):
    return flat(candles.candles(views.events(spark, sf_dir)))


@query(sql.candle(f"select * from ev where block_time < timestamp '{AS_OF}'", "hour"))
def candles_1h(spark, sf_dir):
    return flat(candles.rollup(candles.candles(views.events(spark, sf_dir)), "1h", moment(AS_OF)))


@query(sql.candle(f"select * from ev where block_time < timestamp '{AS_OF}'", "day"))
def candles_1d(spark, sf_dir):
    hours = candles.rollup(candles.candles(views.events(spark, sf_dir)), "1h", moment(AS_OF))
    return flat(candles.rollup(hours, "1d", moment(AS_OF)))


@query(f"select {sql.CANDLE} from c1")
def candles_merge_two_batches(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    late, early = rows.filter(F.col("block_number") > EVENT_FORK), rows.filter(F.col("block_number") <= EVENT_FORK)
    return flat(candles.merge_candles(candles.candles(late), candles.candles(early)))


@query(f"select {sql.CANDLE} from c1")
def candles_below_window(spark, sf_dir):
    kept, older = candles.split_window(views.events(spark, sf_dir), moment(FLOOR))
    return flat(candles.candles(kept.unionByName(older)))


@query(f"select count(*) filter (where block_time >= timestamp '{FLOOR}') as kept, count(*) filter (where block_time < timestamp '{FLOOR}') as discarded from ev")
def window_split_counts(spark, sf_dir):
    return candles.window_counts(views.events(spark, sf_dir), moment(FLOOR))


@query(sql.candle(f"select * from ev where block_number <= {EVENT_FORK}", "minute"))
def candles_after_revert(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return flat(candles.revert_candles(candles.candles(rows), rows, EVENT_FORK))


@query(sql.candle(f"select * from ev where block_number <= {EVENT_FORK}", "hour"))
def candles_1h_after_revert(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return flat(candles.revert_candles(candles.candles(rows, "1h"), rows, EVENT_FORK, "1h"))


@query("select tx_hash, log_index, cast(1 + log_index % 5 as double) * (1 + log_index % 5) as price from sw")
def price_from_sqrt_rows(spark, sf_dir):
    sqrt = (1 + F.col("log_index") % 5) * F.lit(2.0**96)
    rows = views.swaps(spark, sf_dir)
    return rows.select("tx_hash", "log_index", price_from_sqrt(sqrt).alias("price"))


# Trades


@query(
    """select tx_hash, block_number, log_index, pool, sold_token, bought_token, coalesce(value, -1) as value,
  case when sp and bp then 'money_for_money' when sp then 'buy' when bp then 'sell' else 'unpriceable' end as class from val"""
)
def trades_classified(spark, sf_dir):
    pools = views.pools(spark, sf_dir)
    directed = trades.with_direction(trades.with_pool_meta(views.swaps(spark, sf_dir), pools))
    valued = trades.classify(trades.value_trades(directed, views.numeraire(pools)))
    return valued.select("tx_hash", "block_number", "log_index", "pool", "sold_token", "bought_token", F.coalesce(F.floor(F.col("value") + 0.5), F.lit(-1)).cast("long").alias("value"), "class")


@query(
    """select ev.tx_hash, ev.pool, p.close as usd from ev asof left join
  (select pool, bucket + interval 1 hour as available_at, close from ch) p on ev.pool = p.pool and ev.block_time >= p.available_at"""
)
def asof_priced_trades(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    hours = candles.rollup(candles.candles(rows), "1h", moment(AS_OF))
    prices = hours.select("pool", (F.col("bucket") + F.expr("interval 1 hour")).alias("available_at"), "close")
    return trades.asof_price(rows, prices).select("tx_hash", "pool", "usd")


def valued_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified swaps in raw units; OTHER has the price of the reference pool's last close of an earlier day."""
    rows = stored(views.swaps(spark, sf_dir).drop("sender"), "swaps")
    price = F.abs("amount1") / F.abs("amount0")
    day = F.date_trunc("day", "block_time")
    closes = rows.filter(F.col("pool") == POOL).groupBy("pool", (day + F.expr("interval 1 day")).alias("available_at")).agg(F.max_by(price, event_key()).alias("close"))
    pools = stored(views.pools(spark, sf_dir), "pools")
    directed = trades.with_direction(trades.with_pool_meta(views.fine_swaps(rows), views.fine_pools(pools)))
    return trades.classify(trades.value_trades(trades.asof_price(directed, closes, pool=POOL), views.numeraire(pools), "OTHER"))


@query("select tx_hash, block_number, log_index, pool, bought, value, class from vs")
def value_scaled(spark, sf_dir):
    value = F.coalesce(F.floor(F.col("value") + 0.5).cast("long"), F.lit(-1))
    return valued_swaps(spark, sf_dir).select("tx_hash", "block_number", "log_index", "pool", F.col("bought_token").alias("bought"), value.alias("value"), "class")


@query(sql.build("select * from stats", sql.POSITIONS))
def pnl_end_to_end(spark, sf_dir):
    """From swaps in raw units to each wallet's statistics."""
    return revert.replay(stored(trades.position_trades(valued_swaps(spark, sf_dir)), "trades"))["stats"]


def exact_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified swaps of tokens with 18 decimals, with dust behind whole amounts, one in fifty all dust; money has 6. Values are exact."""
    pools = stored(views.pools(spark, sf_dir), "pools")
    own = views.fine_swaps(views.swaps(spark, sf_dir))
    dust = (F.col("log_index") * 123_456_789_123 + 1).cast("decimal(38,0)")
    size = F.when(F.col("log_index") % 50 == 49, dust).otherwise(F.abs("amount0") + dust)
    own = own.withColumn("amount0", (size * F.when(F.col("amount0") < 0, -1).otherwise(1)).cast("decimal(38,0)"))
    own = own.withColumn("amount1", F.when(F.col("log_index") % 50 == 49, F.sign("amount1").cast("long") * (1 + F.col("log_index") % 3)).otherwise(F.col("amount1")))
    prices = views.numeraire(pools).select("token", F.when(F.col("token") == "USD", F.lit(Decimal("0.999987654321012345"))).otherwise(F.lit(Decimal("1.000000000000000001"))).cast("decimal(38,18)").alias("usd"))
    directed = trades.with_direction(trades.with_pool_meta(own, views.fine_pools(pools)))
    return trades.classify(trades.value_trades(directed, prices))


@query("select tx_hash, block_number, log_index, pool, bought, coalesce(cast(value as varchar), '') as value, class from ve")
def value_exact(spark, sf_dir):
    """Values to 8 places, each rounded once; dust keeps its worth."""
    value = F.coalesce(F.col("value").cast("string"), F.lit(""))
    return exact_swaps(spark, sf_dir).select("tx_hash", "block_number", "log_index", "pool", F.col("bought_token").alias("bought"), value.alias("value"), "class")


@query("select wallet, token, side, cast(qty as varchar) as qty, cast(value as varchar) as value, block_number, log_index from wt")
def trades_exact(spark, sf_dir):
    """Position trades in raw units of 18 decimals with exact values."""
    rows = trades.position_trades(exact_swaps(spark, sf_dir))
    return rows.select("wallet", "token", "side", F.col("qty").cast("string").alias("qty"), F.col("value").cast("string").alias("value"), "block_number", "log_index")


@query(
    """select wallet, token, count(*) as lots, cast(sum(remaining) as varchar) as qty, cast(sum(value) as varchar) as bought from (
  select wallet, token, value, cast(b as hugeint) - greatest(done, b0) as remaining from (
    select *, max(c) over (partition by wallet, token) as done from wx) where side = 'buy' and b > greatest(done, b0)) group by 1, 2"""
)
def lots_exact(spark, sf_dir):
    """Open lots of wide positions, what is left of them and what they were bought for."""
    lots = fifo.open_lots(fifo.fifo_axis(trades.position_trades(exact_swaps(spark, sf_dir))))
    held = lots.groupBy("wallet", "token").agg(F.count("*").alias("lots"), F.sum("remaining").cast("decimal(38,0)").alias("qty"), F.sum("lot_value").cast("decimal(38,8)").alias("bought"))
    return held.select("wallet", "token", "lots", F.col("qty").cast("string").alias("qty"), F.col("bought").cast("string").alias("bought"))


@query("select wallet, trades, cast(volume as varchar) as volume, last_active_block, positions, cast(held as varchar) as held from (" + sql.WIDE_CARDS + ")")
def scorecards_wide(spark, sf_dir):
    """Scorecards over raw units of 18 decimals and exact money."""
    run = revert.replay(stored(trades.position_trades(exact_swaps(spark, sf_dir)), "trades"))
    cards = wallets.scorecards_all(run["stats"], run["lots"], run["totals"])
    held = F.aggregate("open_positions", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["qty"]).cast("decimal(38,0)"))
    count = F.coalesce(F.when(F.col("open_positions").isNotNull(), F.size("open_positions")), F.lit(0)).cast("long")
    return cards.select("wallet", "trades", F.col("volume").cast("string").alias("volume"), "last_active_block", count.alias("positions"), F.coalesce(held, F.lit(0)).cast("string").alias("held"))


HOT = 400


@query(sql.build("select * replace (coalesce(lot_log, -1) as lot_log) from cons", sql.HOT_POSITION))
def fifo_hot_position(spark, sf_dir):
    """A third of all trades in one position, which is spread over tasks."""
    rows = position_trades(spark, sf_dir)
    hot = F.col("log_index") % 3 == 0
    return without_nulls(hot_positions.replay_spread(rows.withColumns({c: F.when(hot, "hot").otherwise(F.col(c)) for c in ("wallet", "token")}), HOT)["consumed"])


@query("select pool, arg_max(close, bucket) as usd from c1 where pool = 'purchase' group by pool")
def latest_close(spark, sf_dir):
    return trades.latest_close(candles.candles(views.events(spark, sf_dir)), USER_POOL)


# First in, first out


@query("select wallet, token, block_number, log_index, side, qty, b, c, u from ax")
def fifo_axis(spark, sf_dir):
    return fifo.fifo_axis(position_trades(spark, sf_dir)).select("wallet", "token", "block_number", "log_index", "side", "qty", "b", "c", "u")


def without_nulls(consumed: DataFrame) -> DataFrame:
    """-1 for the missing lot of a tail row: results are compared as plain numbers."""
    return consumed.withColumn("lot_log", F.coalesce("lot_log", F.lit(-1)))


CONSUMED = "select * replace (coalesce(lot_log, -1) as lot_log) from cons"


@query(CONSUMED)
def fifo_consumptions(spark, sf_dir):
    return without_nulls(fifo.fifo_consume(fifo.fifo_axis(position_trades(spark, sf_dir))))


@query("select * from lots")
def fifo_open_lots(spark, sf_dir):
    lots = fifo.open_lots(fifo.fifo_axis(position_trades(spark, sf_dir)))
    return lots.withColumn("cost", fifo.lot_cost(lots))


@query("select wallet, token, cast(sum(remaining) as bigint) as qty_held, cast(sum(cost) as bigint) as cost_basis, count(*) as lots, min(lot_block) as oldest from lots group by 1, 2")
def positions(spark, sf_dir):
    held = fifo.positions(fifo.open_lots(fifo.fifo_axis(position_trades(spark, sf_dir))))
    return held.select("wallet", "token", "qty_held", "cost_basis", F.size("lots").cast("long").alias("lots"), F.col("lots")[0]["lot_block"].alias("oldest"))


@query("select * from tot")
def sell_totals(spark, sf_dir):
    return revert.replay(position_trades(spark, sf_dir))["totals"]


@query("select * from stats")
def wallet_stats(spark, sf_dir):
    return revert.replay(position_trades(spark, sf_dir))["stats"]


# Wash trades, leaderboard, scorecards


@query("select * from own")
def wash_self_trades(spark, sf_dir):
    return wallets.self_traders(views.swaps(spark, sf_dir), WASH["self_least"])


@query("select * from churn")
def wash_churn(spark, sf_dir):
    found = wallets.churners(views.swaps(spark, sf_dir), WASH["churn_least"], WASH["ratio"])
    return found.withColumns({c: F.col(c).cast("long") for c in ("net", "gross")})


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.swaps(spark, sf_dir)
    return wallets.flag_wash(revert.replay(views.position_trades(rows))["stats"], wallets.wash_wallets(rows, **WASH))


@query("select wallet, excluded from flagged")
def wash_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("wallet", "excluded")


@query("select rank, wallet, realized, trades, wins, volume from board")
def leaderboard_top100(spark, sf_dir):
    return wallets.leaderboard(flagged(spark, sf_dir)).select("rank", "wallet", "realized", "trades", "wins", "volume")


@query("select wallet from board where rank <= 20")
def watchlist(spark, sf_dir):
    return wallets.watchlist(flagged(spark, sf_dir), 20)


@query("select rank, wallet, realized from board")
def maintain_watchlist(spark, sf_dir):
    """The snapshot is written and read back, as the readers of the board do."""
    rows = views.swaps(spark, sf_dir)
    board = retention.maintain(revert.replay(views.position_trades(rows))["stats"], rows, 100, **WASH).select("rank", "wallet", "realized")
    held = Snapshots(spark, shared_path(spark, "board"), "rank int, wallet string, realized long")
    held.write(board, 1)
    return held.read()


@query(
    """select s.wallet, s.realized, s.trades, s.wins, coalesce(o.n, 0) as open_positions, coalesce(o.cost, 0) as open_cost, coalesce(r.n, 0) as recent, coalesce(r.realized, 0) as recent_realized
from stats s left join (select wallet, count(distinct token) as n, cast(sum(cost) as bigint) as cost from lots group by 1) o on s.wallet = o.wallet
left join (select wallet, count(*) as n, cast(sum(realized) as bigint) as realized from (
    select * from tot qualify row_number() over (partition by wallet order by sell_block desc, sell_log desc, token) <= 10) group by 1) r on s.wallet = r.wallet"""
)
def scorecards(spark, sf_dir):
    run = revert.replay(position_trades(spark, sf_dir))
    cards = wallets.scorecards_all(run["stats"], run["lots"], run["totals"])

    def total(name: str, part: str) -> F.Column:
        return F.coalesce(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x[part]), F.lit(0))

    def count(name: str) -> F.Column:
        return F.coalesce(F.when(F.col(name).isNotNull(), F.size(name)), F.lit(0)).cast("long")

    return cards.select(
        "wallet", "realized", "trades", "wins", count("open_positions").alias("open_positions"), total("open_positions", "cost").alias("open_cost"), count("recent").alias("recent"), total("recent", "realized").alias("recent_realized")
    )


@query("select wallet, token, cast(sum(remaining) as bigint) as qty, cast(sum(cost) as bigint) as cost from lots where wallet = '7' group by 1, 2")
def scorecard_of_wallet(spark, sf_dir):
    run = revert.replay(position_trades(spark, sf_dir))
    card = wallets.scorecard(run["stats"], run["lots"], run["totals"], WALLET)
    return card.select("wallet", F.explode("open_positions").alias("p")).select("wallet", "p.token", "p.qty", "p.cost")


# Pages


@query(
    f"""select block_number, log_index, tx_hash, amount0, amount1, (select count(*) > 50 from sw where pool = '{POOL}' and (block_number, log_index) < (1200, 0)) as has_more
from sw where pool = '{POOL}' and (block_number, log_index) < (1200, 0) order by block_number desc, log_index desc limit 50"""
)
def swaps_page(spark, sf_dir):
    return pages.swaps_page(views.swaps(spark, sf_dir), POOL, (1200, 0)).select("block_number", "log_index", "tx_hash", "amount0", "amount1", "has_more")


@query(
    f"""select epoch(bucket)::bigint as bucket, close, trade_count,
  (select count(*) > 24 from ch where pool = '{USER_POOL}' and bucket < timestamp '2024-01-20 00:00:00') as has_more
from ch where pool = '{USER_POOL}' and bucket < timestamp '2024-01-20 00:00:00' order by 1 desc limit 24"""
)
def candles_page(spark, sf_dir):
    hours = candles.rollup(candles.candles(views.events(spark, sf_dir)), "1h", moment(AS_OF))
    got = pages.candles_page(hours, USER_POOL, "1h", (moment("2024-01-20 00:00:00"),), 24)
    return got.select(F.unix_timestamp("bucket").alias("bucket"), "close", "trade_count", "has_more")


@query(
    f"""select sell_block, sell_log, consume_seq, token, qty, realized,
  (select count(*) > 30 from cons where wallet = '{WALLET}' and (sell_block, sell_log, consume_seq) < (2000, 5, 1)) as has_more
from cons where wallet = '{WALLET}' and (sell_block, sell_log, consume_seq) < (2000, 5, 1) order by sell_block desc, sell_log desc, consume_seq desc limit 30"""
)
def trades_page(spark, sf_dir):
    consumed = revert.replay(position_trades(spark, sf_dir))["consumed"]
    return pages.trades_page(consumed, WALLET, (2000, 5, 1), 30).select("sell_block", "sell_log", "consume_seq", "token", "qty", "realized", "has_more")


@query("select address, epoch(discovered_at)::bigint as discovered_at, created_block, risk_flags, (select count(*) > 10 from np) as has_more from np order by np.discovered_at desc, address desc limit 10")
def new_pools_page(spark, sf_dir):
    got = pages.new_pools_page(views.new_pools(views.swaps(spark, sf_dir)), None, 10)
    return got.select("address", F.unix_timestamp("discovered_at").alias("discovered_at"), "created_block", F.array_join("risk_flags", ",").alias("risk_flags"), "has_more")


@query("select address, created_block from np where is_indexed")
def indexed_pools(spark, sf_dir):
    return pages.indexed_pools(views.new_pools(views.swaps(spark, sf_dir))).select("address", "created_block")


@query(f"select address, created_block, is_indexed from np where address = '{POOL}'")
def pool_by_address(spark, sf_dir):
    return pages.pool_by_address(views.new_pools(views.swaps(spark, sf_dir)), POOL).select("address", "created_block", "is_indexed")


# Chain


@query(
    """select h.number, case when p.number is null then 'extends' when p.block_hash = h.parent_hash then 'ok' else 'mismatch' end as status
from can h left join hd p on p.number = h.number - 1"""
)
def chain_continuity(spark, sf_dir):
    """Canonical headers against the recorded ones: those above the fork do not fit."""
    rows = views.swaps(spark, sf_dir)
    return chain.continuity(views.headers(rows, FORK), views.headers(rows))


@query("select number, case when exists (select 1 from hd p where p.number = h.number - 1) then 'ok' else 'extends' end as status from hd h")
def chain_links(spark, sf_dir):
    return chain.continuity(views.headers(views.swaps(spark, sf_dir)))


@query(
    """select case when blocks = 1499 - top then top end as fork, case when blocks < 1499 - top then 'hole' end as error from (
  select top, (select count(*) from hd where number > top and number < 1500) as blocks from (
    select max(h.number) as top from hd h join can c on h.number = c.number and h.block_hash = c.block_hash where h.number < 1500 and h.number >= 1100))"""
)
def fork_point(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    return chain.fork_point(views.headers(rows), views.headers(rows, FORK), 1500, FINAL)


@query(f"select pool, count(*) filter (where block_number <= {FINAL}) as final, count(*) filter (where block_number > {FINAL}) as pending from sw group by pool")
def finality_split(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    done = chain.final(rows, FINAL).groupBy("pool").agg(F.count("*").alias("final"))
    open_ = chain.pending(rows, FINAL).groupBy("pool").agg(F.count("*").alias("pending"))
    return done.join(open_, "pool", "full").select("pool", F.coalesce("final", F.lit(0)).alias("final"), F.coalesce("pending", F.lit(0)).alias("pending"))


def state_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("block_number").alias("head_height"), F.max(F.when(F.col("block_number") <= HEAD, F.col("block_number"))).alias("live_cursor")).withColumn("finalized_height", F.lit(FINAL).cast("long"))


@query(f"select max(block_number) as head_height, max(block_number) filter (where block_number <= {HEAD}) as live_cursor, greatest(max(block_number) - max(block_number) filter (where block_number <= {HEAD}), 0) as lag from sw")
def ingest_status(spark, sf_dir):
    return pages.ingest_status(state_of(views.swaps(spark, sf_dir))).select("head_height", "live_cursor", "lag")


@query(f"select least(greatest({FINAL}, least(1150, max(block_number))), max(block_number)) as finalized_height, max(block_number) as head_height from sw")
def advance_finality(spark, sf_dir):
    return chain.advance_finality(state_of(views.swaps(spark, sf_dir)), 1300, 1150).select("finalized_height", "head_height")


COVERED = "(select distinct number // 100 as part from hd where number // 100 <> 15)"


@query(f"select case when (select min(part) from {COVERED}) = 0 then min(part) * 100 + 99 end as cursor from {COVERED} where part + 1 not in (select part from {COVERED})")
def backfill_prefix(spark, sf_dir):
    """Ranges of 100 blocks without the sixteenth."""
    part = F.expr("number div 100")
    ranges = views.headers(views.swaps(spark, sf_dir)).filter(part != 15).groupBy(part.alias("part")).agg(F.count("*").alias("_n"))
    return chain.backfill_cursor(ranges.select((F.col("part") * 100).alias("lo"), (F.col("part") * 100 + 99).alias("hi")), 0)


@query(f"select number, block_hash, parent_hash from hd where number > {FINAL}")
def headers_pruned(spark, sf_dir):
    """Headers written and read back, without those at or below the final height."""
    path = shared_path(spark, "headers")
    views.headers(views.swaps(spark, sf_dir)).write.mode("append").parquet(path)
    return chain.prune_headers(logs.read_headers(spark, path), FINAL).select("number", "block_hash", "parent_hash")


@query("select cast(cast(min(block_time) as date) as varchar) as low, cast(cast(max(block_time) as date) as varchar) as high from hd where number between 100 and 900")
def days_of_blocks(spark, sf_dir):
    found = logs.days_of_blocks(views.headers(views.swaps(spark, sf_dir)), 100, 900)
    return found.select(F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


# Reverts: each equals a clean run up to the fork


@query(f"select pool, count(*) as rows, cast(sum(amount0) as bigint) as net from sw where block_number <= {FORK} group by pool")
def revert_raw(spark, sf_dir):
    return revert.revert_raw(views.swaps(spark, sf_dir), FORK).groupBy("pool").agg(F.count("*").alias("rows"), F.sum("amount0").alias("net"))


@query(f"select count(*) as removed from sw where block_number > {FORK}")
def revert_removed(spark, sf_dir):
    return revert.removed_count(views.swaps(spark, sf_dir), FORK)


@query("with " + sql.rebuilt(CONSUMED, FORK)[5:])
def revert_ledger(spark, sf_dir):
    return without_nulls(revert.revert_ledger(revert.replay(position_trades(spark, sf_dir))["consumed"], FORK)[0])


@query("with " + sql.rebuilt("select wallet, token, lot_block, lot_log, remaining from lots", FORK)[5:])
def revert_lots(spark, sf_dir):
    run = revert.replay(position_trades(spark, sf_dir))
    return revert.restore_lots(run["lots"], revert.revert_ledger(run["consumed"], FORK)[1], FORK)


@query("with " + sql.rebuilt("select * from stats", FORK)[5:])
def revert_stats(spark, sf_dir):
    rows = position_trades(spark, sf_dir)
    run = revert.replay(rows)
    return revert.revert_stats(run["stats"], rows, run["consumed"], FORK)


def book_records(rows: DataFrame, seq: int = 0) -> DataFrame:
    """Swaps as records of a book: headers, events, and burns of one sender; seq orders them from a start on."""
    own = rows.select(
        "*",
        F.lit("swap").alias("kind"),
        (F.abs("amount1") / F.abs("amount0")).alias("price"),
        F.col("pool").alias("token"),
        F.abs("amount0").alias("qty"),
        F.abs("amount1").alias("value"),
        F.col("sender").alias("owner"),
        F.lit("burn").alias("liq"),
    )
    headers = views.headers(rows).withColumnRenamed("number", "block_number").withColumn("kind", F.lit("block"))
    burns = own.filter("sender = '50'").withColumn("kind", F.lit("liq"))
    every = own.unionByName(burns).unionByName(headers, allowMissingColumns=True)
    known = set(every.columns)
    kinds = {c.split()[0]: c.split()[1] for c in book.record().split(", ")}
    order = F.lit(seq) + event_key()
    return every.select(*[order.alias(c) if c == "seq" else (F.col(c).cast(t) if c in known else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def book_mark(spark: SparkSession, kind: str, block: int, seq: int) -> DataFrame:
    """A record that withdraws blocks above one, or makes it final."""
    given = {"seq": F.lit(seq).cast("long"), "kind": F.lit(kind), "from_block": F.lit(block).cast("long")}
    return spark.range(1).select(*[given.get(c.split()[0], F.lit(None).cast(c.split()[1])).alias(c.split()[0]) for c in book.record().split(", ")])


def in_batches(spark: SparkSession, path: str, files: list[DataFrame], schema: str, run: Callable[[DataFrame], None], between: Callable[[int], None] | None = None) -> None:
    """Runs a stream over folders of files in this order, each as one batch, however many files it has; ``between`` acts before a folder comes."""
    with tidy(spark):
        for number, rows in enumerate(files):
            if between is not None:
                between(number)
            rows.write.mode("append").parquet(f"{path}/in{number}")
            run(ingest.read_block_stream(spark, f"{path}/in{{{','.join(map(str, range(number + 1)))},x}}", schema, files=1 << 20))
            Folder(spark, path).delete(f"in{number}")  # it is in the tables


def stream_book(spark: SparkSession, files: list[DataFrame], between: Callable[[book.Book, int], None] | None = None, canonical: Callable[[], DataFrame] | None = None) -> book.Book:
    """A book that has taken files of records in this order, each as one batch; ``between`` acts before a file comes."""
    path = shared_path(spark, "book")
    held = book.Book(spark, path, blocks=500, parts=4, unit="year", canonical=canonical, upkeep=1, keep=1)
    in_batches(spark, path, files, book.record(), lambda stream: ingest.run_available(stream, held.apply, f"{path}/check"), between and (lambda number: between(held, number)))
    return held


def book_totals(held: book.Book, totals: dict[str, str]) -> DataFrame:
    """Rows and a sum of each table. Sums are exact: longs, or decimals of 38 digits where one of them passes a long."""
    sums = [held.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(F.col(c).cast("decimal(38,0)")).alias("total")) for name, c in totals.items()]
    out = sums[0]
    for one in sums[1:]:
        out = out.unionByName(one)
    found = out.collect()  # a row a table
    fits = all(r["total"] is None or -(1 << 63) <= r["total"] < 1 << 63 for r in found)
    kind = "long" if fits else "decimal(38,0)"
    return held.store.spark.createDataFrame([(r["name"], r["rows"], r["total"]) for r in found], "name string, rows long, total decimal(38,0)").withColumn("total", F.col("total").cast(kind))


@query(
    "with " + sql.rebuilt(
        f"""select 'trades' as name, count(*) as rows, cast(sum(qty) as bigint) as total from tr
union all select 'candles', count(*), cast(sum(n) as bigint) from (select pool, block_number, count(*) as n from sw where block_number <= {FORK} group by 1, 2)
union all select 'consumed', count(*), cast(sum(cost) as bigint) from cons
union all select 'lots', count(*), cast(sum(remaining) as bigint) from lots
union all select 'stats', count(*), cast(sum(realized) as bigint) from stats
union all select 'state', 1, {FORK}""", FORK)[5:]
)
def rewind_all(spark, sf_dir):
    """All derived tables taken back in one commit hold what a run up to the fork gives."""
    held = stream_book(spark, [book_records(views.swaps(spark, sf_dir))])
    held.rewind(FORK)
    totals = {"trades": "qty", "1m": "trade_count", "consumed": "cost", "lots": "remaining", "stats": "realized", "state": "live_cursor"}
    return book_totals(held, totals).replace({"1m": "candles"}, subset=["name"])


@query(
    f"""select 'headers' as name, count(*) as rows, cast(sum(number) as bigint) as total from hd
union all select 'swaps', count(*), cast(sum(amount1) as bigint) from sw
union all select 'liq', count(*), cast(sum(amount1) as bigint) from sw where sender = '50'
union all select '1m', count(*), cast(sum(volume1) as bigint) from (select pool, block_time, sum(abs(amount1)) as volume1 from sw group by 1, 2)
union all select '1h', count(*), cast(sum(volume1) as bigint) from (select pool, block_time, sum(abs(amount1)) as volume1 from sw group by 1, 2)
union all select '1d', count(*), cast(sum(volume1) as bigint) from (select pool, block_time, sum(abs(amount1)) as volume1 from sw group by 1, 2)
union all select 'trades', count(*), cast(sum(value) as bigint) from tr
union all select 'consumed', count(*), cast(sum(realized) as bigint) from cons
union all select 'lots', count(*), cast(sum(remaining) as bigint) from lots
union all select 'stats', count(*), cast(sum(realized) as bigint) from stats
union all select 'state', 1, max(block_number) from sw"""
)
def rewind_stream(spark, sf_dir):
    """Half of the chain and an orphan branch by stream, a rewind beside it, then the rest by the same stream: all tables equal a clean run."""
    rows = views.swaps(spark, sf_dir)
    orphans = rows.filter(F.col("block_number").between(FORK + 1, FORK + 300)).withColumns({"tx_hash": F.concat("tx_hash", F.lit("b")), "amount1": F.col("amount1") * 3})
    files = [book_records(rows.filter(F.col("block_number") <= FORK)).unionByName(book_records(orphans)), book_records(rows.filter(F.col("block_number") > FORK))]
    held = stream_book(spark, files, lambda own, number: own.rewind(FORK) if number == 1 else None)
    totals = {"headers": "number", "swaps": "amount1", "liq": "amount1", "1m": "volume1", "1h": "volume1", "1d": "volume1", "trades": "value", "consumed": "realized", "lots": "remaining", "stats": "realized", "state": "live_cursor"}
    return book_totals(held, totals)


@query(f"select sell_tx, sell_log, consume_seq, wallet, token, qty, lot_block, proceeds, cost, realized from cons where sell_block > {FINAL}")
def replay_from_final(spark, sf_dir):
    """Pending sells on a snapshot of the lots at the final block draw the same quantities at the same cost."""
    rows = position_trades(spark, sf_dir)
    lots = revert.replay(rows.filter(F.col("block_number") <= FINAL))["lots"]
    consumed = revert.replay_from(lots, chain.above(rows, FINAL))
    return consumed.select("sell_tx", "sell_log", "consume_seq", "wallet", "token", "qty", "lot_block", "proceeds", "cost", "realized")


@query(
    f"""select count(distinct (wallet, token)) as positions from (
  select wallet, token from lots where lot_block > {FORK} union select wallet, token from cons where sell_block > {FORK} and lot_log is not null)"""
)
def touched_positions(spark, sf_dir):
    run = revert.replay(position_trades(spark, sf_dir))
    return revert.touched_positions(run["lots"], revert.revert_ledger(run["consumed"], FORK)[1], FORK).agg(F.count("*").alias("positions"))


@query(f"select distinct wallet, token from lots where lot_block > {FORK}")
def positions_above_fork(spark, sf_dir):
    held = fifo.positions(fifo.open_lots(fifo.fifo_axis(position_trades(spark, sf_dir))))
    return revert.holding_above(held, FORK).select("wallet", "token")


# Retention


@query(f"select cast(day as varchar) as day, max_block, rows from days where day < date '1998-01-31' - 30 and max_block <= {FINAL}")
def retention_plan(spark, sf_dir):
    found = retention.droppable_days(views.swaps(spark, sf_dir), F.lit("1998-01-31").cast("date"), 30, FINAL)
    return found.select(F.col("day").cast("string").alias("day"), "max_block", "rows")


@query(f"select pool, count(*) as rows from sw where not (block_time < timestamp '1998-01-01' and block_number <= {FINAL}) group by pool")
def retention_kept(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    minutes = candles.candles(views.events(spark, sf_dir))
    kept = retention.retain(rows, minutes, F.lit("1998-01-31").cast("timestamp"), 30, FINAL)["raw"]
    return kept.groupBy("pool").agg(F.count("*").alias("rows"))


@query(
    f"""select pool, count(*) as rows from ev where cast(block_time as date) not in (
  select day from (select cast(block_time as date) as day, max(block_number) as top from ev group by 1) where day < date '2024-01-25' - 10 and top <= {EVENT_FORK}) group by pool"""
)
def retention_days_dropped(spark, sf_dir):
    """What is left of a table written by days once the folders of droppable days are deleted."""
    path = shared_path(spark, "raw")
    logs.write_raw(views.events(spark, sf_dir), path)
    raw = spark.read.parquet(path)
    retention.drop_days(spark, path, retention.droppable_days(raw, moment(AS_OF).cast("date"), 10, EVENT_FORK))
    return spark.read.schema(raw.schema).parquet(path).groupBy("pool").agg(F.count("*").alias("rows"))


@query("select tx_hash, log_index, pool, amount0, amount1 from sw where cast(block_time as date) = date '1996-06-01'")
def cold_export(spark, sf_dir):
    path = shared_path(spark, "cold")
    retention.export_day(views.swaps(spark, sf_dir), "1996-06-01", path)
    kinds = "block_number long, log_index long, tx_hash string, block_time string, pool string, sender string, recipient string, side string, amount0 long, amount1 long"
    return spark.read.schema(kinds).option("header", True).csv(path).select("tx_hash", "log_index", "pool", "amount0", "amount1")


# Decoding


@query(
    """select block_number, tx_hash, cast(log_index as integer) as log_index, '0x' || lower(lpad(hex(cast(sender as bigint)), 40, '0')) as sender,
  '0x' || lower(lpad(hex(cast(recipient as bigint)), 40, '0')) as recipient, cast(amount0 as varchar) as amount0, cast(amount1 as varchar) as amount1,
  cast((1 + log_index % 5) * 79228162514264337593543950336::hugeint as varchar) as sqrt_price_x96, cast(1000 + log_index as varchar) as liquidity,
  cast(amount0 * 10 as integer) as tick from sw where log_index % 7 <> 6"""
)
def decode_swaps(spark, sf_dir):
    found = decode.decode_swaps(views.raw_logs(views.swaps(spark, sf_dir)))
    return found.select("block_number", "tx_hash", "log_index", "sender", "recipient", F.col("amount0_text").alias("amount0"), F.col("amount1_text").alias("amount1"), "sqrt_price_x96", "liquidity", "tick")


@query(
    """select tx_hash, cast(log_index + shift as integer) as log_index, kind, '0x' || lower(lpad(hex(cast(sender as bigint)), 40, '0')) as owner, cast(-(log_index + 1) as integer) as tick_lower, cast(log_index + 1 as integer) as tick_upper,
  case kind when 'collect' then 0 else log_index end as amount, abs(amount0) as amount0, abs(amount1) as amount1
from (select *, 'mint' as kind, 100000 as shift from sw where cast(sender as bigint) < brand % 3 union all select *, 'burn', 200000 from sw where sender = '50' union all select *, 'collect', 300000 from sw where sender = '51')"""
)
def decode_liq(spark, sf_dir):
    found = decode.liq_events(views.raw_logs(views.swaps(spark, sf_dir)))
    whole = {c: F.col(c).cast("long") for c in ("amount", "amount0", "amount1")}
    return found.withColumns(whole).select("tx_hash", "log_index", "kind", "owner", "tick_lower", "tick_upper", "amount", "amount0", "amount1")


@query(
    """select address, outcome, count(*) as logs from (
  select '0x' || lower(lpad(hex(brand), 40, '0')) as address, case when log_index % 7 = 6 then 'unknown' else 'swap' end as outcome from sw
  union all select '0x' || lower(lpad(hex(brand), 40, '0')), 'liq' from sw where cast(sender as bigint) < brand % 3 or sender in ('50', '51')
  union all select '0x' || repeat('f', 40), 'ignored' from (select distinct brand from sw)) group by 1, 2"""
)
def classify_logs(spark, sf_dir):
    return decode.classify_logs(views.raw_logs(views.swaps(spark, sf_dir)))


@query(
    """select address, outcome, count(*) as logs from (
  select '0x' || lower(lpad(hex(brand), 40, '0')) as address, case when log_index % 7 = 6 then 'unknown' else 'swap' end as outcome from sw where brand % 2 = 0
  union all select '0x' || lower(lpad(hex(brand), 40, '0')), 'liq' from sw where brand % 2 = 0 and (cast(sender as bigint) < brand % 3 or sender in ('50', '51'))) group by 1, 2"""
)
def classify_watched(spark, sf_dir):
    """Logs of the indexed pools alone; those of the factory and of other pools are not looked at."""
    rows = views.swaps(spark, sf_dir)
    own = views.new_pools(rows).filter("is_indexed").select(views.contract("address").alias("address"))
    return decode.classify_logs(views.raw_logs(rows), own)


@query(
    """select '0x' || lower(lpad(hex(brand), 40, '0')) as address, '0x' || lower(lpad(hex(brand * 2), 40, '0')) as token0, '0x' || lower(lpad(hex(brand * 2 + 1), 40, '0')) as token1,
  3000 as fee, 60 as tick_spacing, min(block_number) as block_number from sw group by brand"""
)
def decode_pools(spark, sf_dir):
    found = decode.decode_pool_created(views.raw_logs(views.swaps(spark, sf_dir)))
    return found.select("address", "token0", "token1", "fee", "tick_spacing", "block_number")


@query("select distinct pool, '0x' || lower(lpad(hex(brand), 40, '0')) as address from sw")
def address_texts(spark, sf_dir):
    """Addresses held as 20 bytes, as text."""
    raw = F.unhex(F.lpad(F.hex(views.brand()), 40, F.lit("0")))
    return views.swaps(spark, sf_dir).select("pool").distinct().select("pool", address_text(raw).alias("address"))


@query("select number_, cast(number_ as varchar) as plain, cast(-number_ as varchar) as negative from (select distinct amount1 as number_ from sw)")
def wide_numbers(spark, sf_dir):
    """Words in two's complement, both signs, read back as exact text."""
    rows = views.swaps(spark, sf_dir).select(F.col("amount1").alias("number_")).distinct()
    rows = rows.withColumns({"_p": views.word(F.col("number_")), "_n": views.word(-F.col("number_"))})
    rows = rows.withColumns({"_p": limbs("_p", True), "_n": limbs("_n", True)})
    return rows.select("number_", to_text(F.col("_p")).alias("plain"), to_text(F.col("_n")).alias("negative"))


@query(
    """select '0x' || lower(lpad(hex(brand), 40, '0')) as address, block as created_block, providers, case providers when 0 then 'fresh,no_liquidity' when 1 then 'fresh,single_lp' else 'fresh' end as risk_flags
from (select brand, min(block_number) as block, count(distinct sender) filter (where block_number > 0 and block_number <= 250 and cast(sender as bigint) < brand % 3) as providers from sw group by brand) where block between 1 and 250"""
)
def discover_pools(spark, sf_dir):
    found = discovery.discover_pools(views.raw_logs(views.swaps(spark, sf_dir)), 250)
    return found.select("address", "created_block", "providers", F.array_join("risk_flags", ",").alias("risk_flags"))


@query("select address, false as is_indexed from np where not is_indexed")
def capture_pools(spark, sf_dir):
    pools = views.new_pools(views.swaps(spark, sf_dir))
    return discovery.capture_pools(pools.filter("is_indexed"), pools.drop("is_indexed")).select("address", "is_indexed")


@query("select h.number, cast(count(s.block_number) as bigint) as logs, coalesce(min(s.log_index), -1) as first_log from hd h left join (select * from sw where brand = 11) s on h.number = s.block_number group by h.number")
def blocks_with_logs(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    own = views.raw_logs(rows.filter(F.col("pool") == POOL)).filter("log_index < 100000")
    blocks = logs.blocks_with_logs(views.headers(rows), own)
    return blocks.select("number", F.size("logs").cast("long").alias("logs"), F.coalesce(F.get("logs", F.lit(0))["log_index"].cast("long"), F.lit(-1)).alias("first_log"))


@query(
    """select h.number, cast(count(l.block_number) as bigint) as logs, coalesce(min(l.log_index), -1) as first_log from hd h left join (
  select block_number, log_index from sw union all select block_number, 100000 + log_index from sw where cast(sender as bigint) < brand % 3
  union all select block_number, 200000 + log_index from sw where sender = '50' union all select block_number, 300000 + log_index from sw where sender = '51'
  union all select min(block_number), 400000 + brand from sw group by brand) l on h.number = l.block_number group by h.number"""
)
def blocks_with_all_logs(spark, sf_dir):
    """Like blocks_with_logs, of all contracts and kinds of logs. Trades are dealt by block before they are encoded, which makes them many times as long."""
    rows = stored(views.swaps(spark, sf_dir), "swaps")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = views.event_logs(rows.repartition(parts, "block_number")).unionByName(views.created_logs(rows).repartition(parts, "block_number"))
    blocks = logs.blocks_with_logs(views.headers(rows), own)
    return blocks.select("number", F.size("logs").cast("long").alias("logs"), F.coalesce(F.get("logs", F.lit(0))["log_index"].cast("long"), F.lit(-1)).alias("first_log"))


@query(f"select block_number, tx_hash, log_index from ({ALL_LOGS})")
def blocks_exploded(spark, sf_dir):
    """Blocks with their logs, taken apart again: every log of every block."""
    rows = views.swaps(spark, sf_dir)
    return logs.explode_blocks(logs.blocks_with_logs(views.headers(rows), views.raw_logs(rows)))[1].select("block_number", "tx_hash", "log_index")


@query(f"select block_number, tx_hash, log_index from ({ALL_LOGS}) where brand = 11 and block_number between 100 and 900")
def scan_written_logs(spark, sf_dir):
    """Logs written, and those of a range of blocks and one contract read back."""
    path = shared_path(spark, "logs")
    views.raw_logs(views.swaps(spark, sf_dir)).write.mode("append").parquet(path)
    return logs.scan_logs(logs.read_logs(spark, path), 100, 900, ["0x" + f"{11:x}".zfill(40)]).select("block_number", "tx_hash", "log_index")


@query("select distinct block_number from sw where brand = 11 and block_number between 100 and 900")
def active_blocks(spark, sf_dir):
    address = "0x" + f"{11:x}".zfill(40)
    return logs.active_blocks(views.raw_logs(views.swaps(spark, sf_dir)), 100, 900, [address])


# Alerts


def watched(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("recipient").cast("long") <= 30).select(F.col("recipient").alias("wallet")).distinct()


@query(
    """select 'move:' || tx_hash || ':' || log_index as alert_key, recipient as wallet, pool, side, abs(amount1) as value
from sw where block_number > 900 and block_number <= 1200 and recipient in (select wallet from watched) and abs(amount1) >= 5000000"""
)
def watchlist_moves(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    found = alerts.watchlist_moves(rows.withColumn("value", F.abs("amount1")), watched(rows), 5_000_000, HEAD, 300)
    return found.select("alert_key", "wallet", "pool", "side", "value")


@query(
    f"""select 'cluster:' || token || ':' || (first_time // {15 * DAY}) as alert_key, token, wallets, first_time, last_time from (
  select pool as token, count(distinct recipient) as wallets, epoch(min(block_time))::bigint as first_time, epoch(max(block_time))::bigint as last_time
  from sw where block_number > 1180 and block_number <= 1200 and side = 'buy' and recipient in (select wallet from watched) group by 1)
where wallets >= 3 and last_time - first_time <= {15 * DAY}"""
)
def cluster_buys(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    buys = rows.filter("side = 'buy'").withColumn("token", F.col("pool"))
    return alerts.cluster_buys(buys, watched(rows), HEAD, 20, 3, 15 * DAY).select("alert_key", "token", "wallets", "first_time", "last_time")


@query("select 'newpool:' || address as alert_key, address, 'new pool ' || address || ' ' || risk_flags as text from np where not is_indexed order by discovered_at desc, address limit 200")
def new_pool_alerts(spark, sf_dir):
    return alerts.new_pool_alerts(views.new_pools(views.swaps(spark, sf_dir)))


@query("select 'newpool:' || address as alert_key from np where not is_indexed and created_block > 1 or not is_indexed and address < 'Brand#2'")
def unsent_alerts(spark, sf_dir):
    """Claims half of the keys first, then all: the second pass delivers the rest only."""
    found = alerts.new_pool_alerts(views.new_pools(views.swaps(spark, sf_dir)))
    new = views.new_pools(views.swaps(spark, sf_dir)).filter("not is_indexed and created_block <= 1 and address >= 'Brand#2'")
    path = shared_path(spark, "sent")
    none = spark.createDataFrame([], "alert_key string, sent_at timestamp")
    alerts.claim_new(alerts.new_pool_alerts(new), path, none, moment(AS_OF))
    return alerts.unsent(found, spark.read.schema("alert_key string, sent_at timestamp").parquet(path)).select("alert_key")


HEADS = f"(values {', '.join(f'({n}, {head})' for n, head in enumerate(TICKS, 1))}) as heads(tick, head)"


@query(
    f"""select alert_key, min(tick) as tick from (
  select 'move:' || tx_hash || ':' || log_index as alert_key, tick from sw join {HEADS} on block_number > head - 300 and block_number <= head
  where recipient in (select wallet from watched) and abs(amount1) >= 5000000
  union all select 'cluster:' || token || ':' || (first_time // {15 * DAY}), tick from (
    select tick, pool as token, count(distinct recipient) as wallets, epoch(min(block_time))::bigint as first_time, epoch(max(block_time))::bigint as last_time
    from sw join {HEADS} on block_number > head - 20 and block_number <= head where side = 'buy' and recipient in (select wallet from watched) group by 1, 2)
  where wallets >= 3 and last_time - first_time <= {15 * DAY}
  union all select 'newpool:' || address, tick from np join {HEADS} on created_block <= head where not is_indexed) group by 1"""
)
def alert_ticks(spark, sf_dir):
    """Three ticks over windows that overlap: each key goes out once, at the first tick that finds it."""
    rows = views.swaps(spark, sf_dir)
    valued = rows.withColumns({"value": F.abs("amount1"), "token": F.col("pool")})
    path, sent = shared_path(spark, "sent"), spark.createDataFrame([], alerts.SENT)
    for number, head in enumerate(TICKS, 1):
        found = alerts.tick(valued, watched(rows), views.new_pools(rows), head, (300, 20), 5_000_000, 3, 15 * DAY)
        alerts.claim_new(found, path, sent, F.expr(f"timestamp '{AS_OF}' + interval {number} days"))
        sent = spark.read.schema(alerts.SENT).parquet(path)
    return sent.select("alert_key", F.datediff("sent_at", moment(AS_OF)).alias("tick"))


# Keyed tables


@query("select tx_hash, log_index, pool from ev where block_number > 600")
def append_rows(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    batch = rows.filter("block_number > 500").unionByName(rows.filter("block_number > 700"))
    return append_new(rows.filter("block_number <= 600"), batch, ["tx_hash", "log_index"]).select("tx_hash", "log_index", "pool")


@query("select recipient, pool, max(block_number * 1048576 + log_index) as version, arg_max(price, block_number * 1048576 + log_index) as price from ev group by 1, 2")
def upsert_latest(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("recipient", "pool", (F.col("block_number") * F.lit(1 << 20) + F.col("log_index")).alias("version"), "price", "block_number")
    old, new = rows.filter("block_number <= 600").drop("block_number"), rows.filter("block_number > 400").drop("block_number")
    return upsert(old, new, ["recipient", "pool"], "version")


@query("select recipient, count(*) as trades, cast(sum(abs(amount0)) as bigint) as volume, max(block_number) as last_block from ev group by 1")
def merge_counters(spark, sf_dir):
    rows = views.events(spark, sf_dir)

    def counted(part: DataFrame) -> DataFrame:
        return part.groupBy("recipient").agg(F.count("*").alias("trades"), F.sum(F.abs("amount0")).alias("volume"), F.max("block_number").alias("last_block"))

    return merge_add(counted(rows.filter("block_number <= 600")), counted(rows.filter("block_number > 600")), ["recipient"], ["trades", "volume"], ["last_block"])


@query(
    f"""select cast(cast(block_time as date) as varchar) as day, pool, block_time >= timestamp '{FLOOR}' as kept, count(*) as rows, cast(sum(amount0) as bigint) as net from ev group by 1, 2, 3"""
)
def bulk_load(spark, sf_dir):
    """Text staging, cast and split, written by day and read back."""
    rows = views.events(spark, sf_dir)
    text = rows.select(*[(F.unix_timestamp(c) if c == "block_time" else F.col(c)).cast("string").alias(c) for c in rows.columns])
    kept, older = logs.load_backfill(text, dict(rows.dtypes), moment(FLOOR))
    path = shared_path(spark, "raw")
    logs.write_raw(kept, path)
    parts = spark.read.parquet(path).select("block_time", "pool", "amount0", F.lit(True).alias("kept"))
    both = parts.unionByName(older.select("block_time", "pool", "amount0", F.lit(False).alias("kept")))
    return both.groupBy(F.to_date("block_time").cast("string").alias("day"), "pool", "kept").agg(F.count("*").alias("rows"), F.sum("amount0").alias("net"))


# Streams


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    return rows.select((F.col("block_number") * 10 + F.col("log_index")).alias("seq"), F.lit("data").alias("kind"), F.lit(None).cast("long").alias("from_block"), *[F.col(c.split()[0]).cast(c.split()[1]) for c in ingest.TRADE.split(", ")])


def fifths(rows: DataFrame) -> list[F.Column]:
    """Five conditions by block range."""
    top = rows.agg(F.max("block_number")).first()[0] or 0
    step = top // 5 + 1
    return [F.expr(f"block_number div {step} = {k}") for k in range(5)]


@query(f"select {sql.CANDLE} from c1")
def stream_candles(spark, sf_dir):
    """Five files and the third once more."""
    rows, path = records(spark, sf_dir), shared_path(spark, "stream")
    parts = fifths(rows)
    state = ingest.Ingest(spark, path)
    in_batches(spark, path, [rows.filter(p) for p in [*parts, parts[2]]], ingest.RECORD, lambda stream: ingest.run_available(stream, state.apply, f"{path}/check"))
    return flat(state.store.read("candles"))


@query("select tx_hash, log_index, pool from ev")
def stream_dedupe(spark, sf_dir):
    rows, path = records(spark, sf_dir), shared_path(spark, "stream")
    parts = fifths(rows)
    files = [rows.filter(p) for p in [parts[0], parts[1], parts[1], *parts[2:], parts[4]]]
    in_batches(spark, path, files, ingest.RECORD, lambda stream: ingest.write_rows_stream(ingest.deduplicated(stream, "30 days").drop("seq", "kind", "from_block"), f"{path}/out", f"{path}/check"))
    return spark.read.schema(ingest.TRADE).parquet(f"{path}/out").select("tx_hash", "log_index", "pool")


@query(sql.candle(f"select block_number, log_index, pool, block_time, amount0, amount1, case when block_number > {EVENT_FORK} then price + 1 else price end as price from ev", "minute"))
def stream_revert(spark, sf_dir):
    """All blocks, a revert, and the blocks above it again with other prices."""
    rows, path = records(spark, sf_dir), shared_path(spark, "stream")
    above = F.col("block_number") > EVENT_FORK
    top = F.lit(1 << 40)
    mark = rows.limit(1).select(top.alias("seq"), F.lit("revert").alias("kind"), F.lit(EVENT_FORK).cast("long").alias("from_block"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ingest.TRADE.split(", ")])
    again = rows.filter(above).withColumns({"seq": top + 1 + F.col("seq"), "price": F.col("price") + 1, "tx_hash": F.concat("tx_hash", F.lit("b"))})
    state = ingest.Ingest(spark, path)
    in_batches(spark, path, [rows.filter(~above), rows.filter(above), mark.unionByName(again)], ingest.RECORD, lambda stream: ingest.run_available(stream, state.apply, f"{path}/check"))
    return flat(state.store.read("candles"))


@query("select wallet, token, lot_block, lot_log, remaining from lots")
def stream_fifo(spark, sf_dir):
    """Positions from three files; each batch is played on top of the open lots."""
    rows = book_records(views.swaps(spark, sf_dir)).filter("kind = 'swap'")
    held = stream_book(spark, [rows.filter(F.col("block_number") < 800), rows.filter(F.col("block_number").between(800, 1599)), rows.filter(F.col("block_number") >= 1600)])
    return held.read("lots").select("wallet", "token", "lot_block", "lot_log", "remaining")


@query(
    """select 'consumed' as name, wallet, token, sell_block as block, sell_log as log, consume_seq as seq, qty, proceeds, realized from cons
union all select 'lots', wallet, token, lot_block, lot_log, 0, remaining, cost, lot_value from lots
union all select 'stats', wallet, '', last_active_block, trades, cast(wins as integer), volume, avg_size, realized from stats"""
)
def stream_fifo_revert(spark, sf_dir):
    """Ledger, lots and statistics of a stream with orphan branches, reverts, late and repeated rows equal those of a clean run."""
    rows = views.swaps(spark, sf_dir)
    swaps = book_records(rows).filter("kind = 'swap'")
    late = F.col("block_number").between(500, 700) & (F.col("log_index") % 10 == 3)
    top = 1 << 50

    def orphans(low: int, high: int) -> DataFrame:
        return swaps.filter(F.col("block_number").between(low, high)).withColumns({"tx_hash": F.concat("tx_hash", F.lit("b")), "qty": F.col("qty") + 7, "value": F.col("value") * 2})

    def later(part: DataFrame, steps: int) -> DataFrame:
        return part.withColumn("seq", F.col("seq") + steps * top)

    between = F.col("block_number").between
    files = [
        swaps.filter((F.col("block_number") <= 1000) & ~late),
        orphans(1001, 1300),
        # two forks in one batch, the second deeper, each followed by a branch
        book_mark(spark, "revert", 1100, top).unionByName(later(orphans(1101, 1200), 1)).unionByName(book_mark(spark, "revert", 1000, 3 * top)).unionByName(later(swaps.filter(between(1001, 1500)), 3)),
        swaps.filter((F.col("block_number") <= 1000) & late).unionByName(swaps.filter(between(600, 650))).unionByName(orphans(1501, 1600)),
        book_mark(spark, "final", 900, 1).unionByName(book_mark(spark, "revert", 1500, 2)).unionByName(later(swaps.filter(F.col("block_number") > 1500), 1)),
    ]
    held = stream_book(spark, files)
    lots = held.read("lots")
    none = F.lit("")
    kinds = {"block": "long", "log": "long", "seq": "int", "qty": "long", "proceeds": "long", "realized": "long"}

    def shaped(table: DataFrame, name: str, token: F.Column, *columns: str | F.Column) -> DataFrame:
        return table.select(F.lit(name).alias("name"), "wallet", token.alias("token"), *[(F.col(c) if isinstance(c, str) else c).cast(t).alias(n) for c, (n, t) in zip(columns, kinds.items())])

    out = shaped(held.read("consumed"), "consumed", F.col("token"), "sell_block", "sell_log", "consume_seq", "qty", "proceeds", "realized")
    out = out.unionByName(shaped(lots, "lots", F.col("token"), "lot_block", "lot_log", F.lit(0), "remaining", fifo.lot_cost(lots), "lot_value"))
    return out.unionByName(shaped(held.stats(), "stats", none, "last_active_block", "trades", "wins", "volume", "avg_size", "realized"))


@query(f"select {sql.CANDLE} from c1")
def stream_tumbling(spark, sf_dir):
    """Windows of five files; a tenth of the first file's rows comes last of all, weeks late, and counts."""
    rows, path = records(spark, sf_dir), shared_path(spark, "stream")
    parts = fifths(rows)
    late = parts[0] & (F.col("log_index") == 3)
    state = ingest.Tumbling(spark, f"{path}/out", "month")
    in_batches(spark, path, [rows.filter(p) for p in [parts[0] & ~late, *parts[1:], late]], ingest.RECORD, lambda stream: ingest.run_available(stream, state.apply, f"{path}/check"))
    return flat(state.store.read("candles"))


@query(" union all ".join(f"select '{r}' as name, * from ({sql.candle('select * from ev where block_number <= 800', unit)})" for r, unit in (("1h", "hour"), ("1d", "day"))))
def stream_rollups(spark, sf_dir):
    """Hours and days follow their minutes: new events are added, those of withdrawn blocks taken out."""
    rows = views.events(spark, sf_dir)
    own = rows.select("*", F.lit("swap").alias("kind"), (F.col("block_number") * 16 + F.col("log_index")).alias("seq"))
    known = set(own.columns)
    every = own.select(*[(F.col(c.split()[0]).cast(c.split()[1]) if c.split()[0] in known else F.lit(None).cast(c.split()[1])).alias(c.split()[0]) for c in book.record().split(", ")])
    block = F.col("block_number")
    orphans = every.filter(block.between(EVENT_FORK + 1, 700)).withColumns({"tx_hash": F.concat("tx_hash", F.lit("b")), "price": F.col("price") * 3})
    files = [every.filter(block <= EVENT_FORK).unionByName(orphans), book_mark(spark, "revert", EVENT_FORK, -1).unionByName(every.filter(block.between(EVENT_FORK + 1, 800)))]
    held = stream_book(spark, files)
    return flat_named(held.read("1h"), "1h").unionByName(flat_named(held.read("1d"), "1d"))


def flat_named(rows: DataFrame, name: str) -> DataFrame:
    return flat(rows).withColumn("name", F.lit(name))


@query(f"select {FORK} as from_block, 1501 as mismatch, 1900 as live_cursor, 1900 - min(block_number) + 1 as headers from sw")
def stream_detect_reverts(spark, sf_dir):
    """Headers of one branch, then one of another that does not fit: the fork is found, the tables go back to it, and the branch's blocks from there on are taken."""
    # a header for every day from the first block on, also where nothing was traded
    days = views.swaps(spark, sf_dir).agg(F.min("block_number").alias("low")).select(F.explode(F.sequence("low", F.lit(1900))).alias("block_number"))
    rows = days.withColumn("block_time", F.timestamp_seconds(F.col("block_number") * DAY))
    recorded, canonical = views.headers(rows), views.headers(rows, FORK)
    kinds = {c.split()[0]: c.split()[1] for c in book.record().split(", ")}

    def given(headers: DataFrame, low: int, high: int) -> DataFrame:
        own = headers.filter(F.col("number").between(low, high)).select(F.col("number").alias("seq"), F.lit("block").alias("kind"), F.col("number").alias("block_number"), "block_time", "block_hash", "parent_hash")
        return own.select(*[(F.col(c).cast(t) if c in own.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])

    held = stream_book(spark, [given(recorded, 0, 800), given(recorded, 801, 1500), given(canonical, 1501, 1501), given(canonical, FORK + 1, 1900)], canonical=lambda: canonical)
    top = held.read("headers").agg(F.count("*").alias("headers"))
    return held.read("reverts").select("from_block", "mismatch").crossJoin(held.read("state").select("live_cursor")).crossJoin(top)


@query(
    """select pool, epoch(bucket)::bigint as bucket, trade_count, cast(volume0::hugeint * 100000000000000 as varchar) || lpad(cast(lows as varchar), 26, '0') as volume0,
  cast(volume1::hugeint * 100000000000000 as varchar) || lpad(cast(lows as varchar), 26, '0') as volume1 from (
  select pool, date_trunc('day', block_time) as bucket, count(*) as trade_count, sum(abs(amount0)) as volume0, sum(abs(amount1)) as volume1, sum(log_index) as lows from ev group by 1, 2)"""
)
def candles_wide(spark, sf_dir):
    """Day candles, by way of minutes, of amounts of over 40 digits."""
    rows = views.events(spark, sf_dir)

    def wide(amount: str) -> F.Column:
        sign = F.when(F.col(amount) < 0, -1).otherwise(1)
        parts = {"low": F.col("log_index") * sign, "mid": F.col(amount).cast("decimal(20,0)") * F.lit(10**14).cast("decimal(15,0)"), "high": F.lit(0)}
        return F.struct(*[v.cast("decimal(38,0)").alias(k) for k, v in parts.items()])

    minutes = candles.wide_candles(rows.withColumns({c: wide(c) for c in ("amount0", "amount1")}))
    days = candles.wide_rollup(candles.wide_rollup(minutes, "1h"), "1d")
    return days.select("pool", F.unix_timestamp("bucket").alias("bucket"), "trade_count", to_text(F.col("volume0")).alias("volume0"), to_text(F.col("volume1")).alias("volume1"))


@query(f"select block_number, tx_hash, log_index from ({ALL_LOGS}) where brand % 2 = 0 and brand > 0 and block_number between 100 and 900")
def scan_pruned_logs(spark, sf_dir):
    """Logs by month; only the months of a range of blocks are read, and the contracts of a table are kept."""
    rows, path = views.swaps(spark, sf_dir), shared_path(spark, "logs")
    headers = views.headers(rows)
    logs.write_logs(views.raw_logs(rows), headers, path, "month")
    own = views.new_pools(rows).filter("is_indexed").select(views.contract("address").alias("address"))
    return logs.scan_logs(spark.read.parquet(path), 100, 900, own, headers, "month").select("block_number", "tx_hash", "log_index")


# Quality


@query("select min(number) as first, max(number) as last, count(*) as count, max(number) - min(number) + 1 = count(*) as gap_free from hd")
def quality_gap(spark, sf_dir):
    return quality.check_gap_free(views.headers(views.swaps(spark, sf_dir)))


@query("select min(number) as first, max(number) as last, count(*) as count, max(number) - min(number) + 1 = count(*) as gap_free from hd where number % 100 <> 50")
def quality_gap_found(spark, sf_dir):
    return quality.check_gap_free(views.headers(views.swaps(spark, sf_dir)).filter("number % 100 <> 50"))


@query("select live_cursor, top, live_cursor <= top as ok from (select max(number) filter (where number <= {HEAD}) as live_cursor, max(number) as top from hd)".replace("{HEAD}", str(HEAD)))
def quality_cursor(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    return quality.check_cursor(state_of(rows), views.headers(rows))


@query("select live_cursor, top, live_cursor <= top as ok from (select max(number) + 7 as live_cursor, max(number) as top from hd)")
def quality_cursor_found(spark, sf_dir):
    """A cursor seven blocks ahead of the rows."""
    rows = views.swaps(spark, sf_dir)
    return quality.check_cursor(state_of(rows).withColumn("live_cursor", F.col("head_height") + 7), views.headers(rows))


@query(f"select count(*) as orphans from sw where block_number > {FORK}")
def quality_parity(spark, sf_dir):
    rows = views.swaps(spark, sf_dir)
    return quality.check_event_parity(views.headers(rows).filter(F.col("number") <= FORK), rows)


LEDGER = "select *, stats_realized = ledger_realized as equal from (select cast((select sum(realized) from stats) as bigint) as stats_realized, cast((select sum(realized) from cons) as bigint) as ledger_realized)"


@query(LEDGER)
def quality_ledger(spark, sf_dir):
    run = revert.replay(position_trades(spark, sf_dir))
    return quality.check_ledger(run["stats"], run["consumed"])


@query(LEDGER.replace("from cons", f"from cons where sell_block <= {FORK}"))
def quality_ledger_found(spark, sf_dir):
    """A ledger that has lost the sells above the fork."""
    run = revert.replay(position_trades(spark, sf_dir))
    return quality.check_ledger(run["stats"], run["consumed"].filter(F.col("sell_block") <= FORK))


@query(
    """select count(*) as positions, count(*) filter (where held <> bought) as faults from (select wallet, token, sum(remaining) as held from lots group by 1, 2)
join (select wallet, token, max(b) - max(c) as bought from ax group by 1, 2) using (wallet, token)"""
)
def quality_lots(spark, sf_dir):
    return quality.check_lots(fifo.positions(fifo.open_lots(fifo.fifo_axis(position_trades(spark, sf_dir)))))


@query("select count(*) as positions, count(*) filter (where cast(wallet as bigint) % 2 = 0) as faults from (select distinct wallet, token from lots)")
def quality_lots_found(spark, sf_dir):
    """Positions of even wallets hold one more than their lots."""
    held = fifo.positions(fifo.open_lots(fifo.fifo_axis(position_trades(spark, sf_dir))))
    return quality.check_lots(held.withColumn("qty_held", F.col("qty_held") + F.when(F.col("wallet").cast("long") % 2 == 0, 1).otherwise(0)))


KINDS = """select count(*) as rows, count(*) filter (where kind not in ('mint', 'burn', 'collect')) as bad_kind,
  count(*) filter (where not regexp_matches(owner, '^0x[0-9a-f]{40}$')) as bad_address, count(*) filter (where block < 0) as bad_block from (select """


@query(KINDS + "kind, '0x' || lower(lpad(hex(cast(sender as bigint)), 40, '0')) as owner, block_number as block from (" + LIQUIDITY + "))")
def quality_kinds(spark, sf_dir):
    return quality.check_kinds(decode.liq_events(views.raw_logs(views.swaps(spark, sf_dir))))


@query(
    KINDS + """case when (log_index + shift) % 3 = 0 then 'swap' else kind end as kind, '0x' || lower(lpad(hex(cast(sender as bigint)), 40, '0')) || case when (log_index + shift) % 5 = 0 then '0' else '' end as owner,
  case when (log_index + shift) % 7 = 0 then -1 else block_number end as block from (""" + LIQUIDITY + "))"
)
def quality_kinds_found(spark, sf_dir):
    """Every third log of a wrong kind, every fifth with an address too long, every seventh below block 0."""
    found = decode.liq_events(views.raw_logs(views.swaps(spark, sf_dir)))

    def every(n: int, wrong: F.Column, name: str) -> F.Column:
        return F.when(F.col("log_index") % n == 0, wrong).otherwise(F.col(name))

    return quality.check_kinds(found.withColumns({"kind": every(3, F.lit("swap"), "kind"), "owner": every(5, F.concat("owner", F.lit("0")), "owner"), "block_number": every(7, F.lit(-1), "block_number")}))


@query(f"select wallet, token, block_number, log_index, 'left' as side_ from tr where block_number > {FORK}")
def state_diff(spark, sf_dir):
    rows = position_trades(spark, sf_dir).select("wallet", "token", "block_number", "log_index")
    return quality.diff_state(rows, revert.revert_raw(rows, FORK)).withColumnRenamed("side", "side_")


@query("select count(*) filter (where excluded) as excluded, count(*) as wallets from flagged")
def excluded_wallets(spark, sf_dir):
    return flagged(spark, sf_dir).agg(F.count_if("excluded").alias("excluded"), F.count("*").alias("wallets"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
