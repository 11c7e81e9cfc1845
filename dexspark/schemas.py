"""Column types of the tables; applied on read, never inferred."""

from __future__ import annotations

RAW_LOGS = "address string, topics array<string>, data string, block_number long, tx_hash string, log_index int"
HEADERS = "number long, block_hash string, parent_hash string, block_time timestamp"
CANDLES = (
    "resolution string, pool string, bucket timestamp, open double, high double, low double, close double, "
    "volume0 decimal(38,0), volume1 decimal(38,0), trade_count long, open_key long, close_key long"
)
SNAPSHOT_LEADERS = "rank int, wallet string, realized long"
ALERTS_SENT = "alert_key string, sent_at timestamp"

#: Distance between blocks in the packed order key; log indices stay below it.
KEY_STEP = 1 << 20
