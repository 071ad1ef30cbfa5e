"""The registered queries of the library's own operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color, dates, hooks, text
from ..operators import aggregates, images, lookups, sequences, settings
from ..operators.ranges import ranged
from ..sources import files
from ..store import new_path
from ..streaming import jobs as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "burst_counts"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, *columns: str, order=("ts", "event_id")) -> DataFrame:
    """Events in ranges of user and time, if they are many."""
    return ranged(_table(spark, sf_dir, "events").select(*columns), "user_id", list(order))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Event histories

COLLAPSED = "SELECT * FROM (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS n FROM events {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM prev"
BURSTS = "SELECT event_id, user_id, least(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) / 15.0, 1.0)::DOUBLE AS ratio FROM ({src})"


@query(f"SELECT event_id, user_id, event_type FROM ({COLLAPSED.format(where='')})")
def collapse_repeats(spark, sf_dir):
    return sequences.collapse_repeats(_events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id, event_type FROM ({COLLAPSED.format(where=chr(32).join(['WHERE event_type IS DISTINCT FROM', chr(39) + 'error' + chr(39)]))})")
def remove_key_and_collapse(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    return sequences.remove_key_and_collapse(e, "error").select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id, round(ratio, 9) AS ratio FROM ({BURSTS.format(src='SELECT * FROM events')})")
def burst_ratio(spark, sf_dir):
    e = _events(spark, sf_dir, "event_id", "ts", "user_id")
    return sequences.burst_ratio(e, 3600).select("event_id", "user_id", F.round("ratio", 9).alias("ratio"))


@query(f"SELECT user_id, count(*) AS n, round(max(ratio), 9) AS most FROM ({BURSTS.format(src=COLLAPSED.format(where=''))}) GROUP BY user_id")
def burst_counts(spark, sf_dir):
    """Repeats collapsed, bursts measured, counted by user: one exchange serves all three."""
    e = sequences.collapse_repeats(_events(spark, sf_dir, "event_id", "ts", "user_id", "event_type"))
    return sequences.burst_ratio(e, 3600).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("ratio"), 9).alias("most"))


@query(f"SELECT b.event_id, b.user_id, round(e.value * 1.5 * (1 + b.ratio), 6) AS delta FROM ({BURSTS.format(src='SELECT * FROM events')}) b JOIN events e USING (event_id)")
def burst_delta(spark, sf_dir):
    e = sequences.burst_ratio(_events(spark, sf_dir, "event_id", "ts", "user_id", "value"), 3600)
    return e.select("event_id", "user_id", F.round(sequences.boosted(F.col("value"), F.col("ratio")), 6).alias("delta"))


@query("""
WITH k AS (SELECT i AS k, (12 - abs(i - 12)) / 144.0::DOUBLE AS w FROM range(24) t(i))
SELECT user_id, floor(epoch_us(ts) / 1000 / 60000)::BIGINT + k AS frame, round(sum(value * w), 9) AS delta FROM events, k GROUP BY 1, 2""")
def spread_impulses(spark, sf_dir):
    """Impulses spread over frames of a minute, for events are sparse."""
    out = sequences.spread_impulses(_table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", 60_000)
    return out.withColumn("delta", F.round("delta", 9))


SHAPED = """
WITH k AS (SELECT i AS k, abs(i - 12) / 12.0::DOUBLE AS x FROM range(24) t(i)), w AS (SELECT k, {shape} / 12 AS w FROM k)
SELECT user_id, floor(epoch_us(ts) / 1000 / 60000)::BIGINT + k AS frame, {sum} AS delta FROM events, w GROUP BY 1, 2"""


def _shaped(spark, sf_dir, mode: str, whole: bool = False) -> DataFrame:
    out = sequences.spread_impulses(_table(spark, sf_dir, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", 60_000, mode, whole=whole)
    return out.withColumn("delta", F.round("delta", 9))


@query(SHAPED.format(shape="0.75::DOUBLE * (1 - x * x)", sum="round(sum(value * w), 9)"))
def spread_quadratic(spark, sf_dir):
    return _shaped(spark, sf_dir, "quadratic")


@query(SHAPED.format(shape="(1 + cos(pi() * x)) / 2", sum="round(sum(value * w), 9)"))
def spread_cosine(spark, sf_dir):
    return _shaped(spark, sf_dir, "cosine")


@query(SHAPED.format(shape="0.5::DOUBLE", sum="round_even(round(sum(value * w), 9), 0)"))
def spread_whole(spark, sf_dir):
    """The constant kernel, each frame a whole number, halves to even."""
    return _shaped(spark, sf_dir, "constant", whole=True)


@query("""
WITH p AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'main' ELSE 'sub' END AS track, value FROM events WHERE event_type IN ('view', 'click')),
a AS (SELECT user_id, event_id, last_value(CASE WHEN track = 'main' THEN value END IGNORE NULLS) OVER w AS main, last_value(CASE WHEN track = 'sub' THEN value END IGNORE NULLS) OVER w AS sub FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, main, sub FROM a WHERE abs(main - sub) > 20""")
def drift_events(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    p = e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "view", "main").otherwise("sub").alias("track"), F.col("value").alias("position"))
    return sequences.drift_events(ranged(p, "user_id", ["ts", "event_id"]), 20, "user_id").select("user_id", "event_id", "main", "sub")


PLAYED = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' THEN 'main' ELSE 'sub' END AS track, value AS position, event_type <> 'purchase' AS playing FROM events WHERE event_type IN ('view', 'click', 'purchase')"


def _played(events: DataFrame) -> DataFrame:
    """Positions of two tracks: views of main, clicks and purchases of sub, which a purchase stops."""
    kind = F.col("event_type")
    return events.where(kind.isin("view", "click", "purchase")).select(
        "user_id", "event_id", "ts", F.when(kind == "view", "main").otherwise("sub").alias("track"), F.col("value").alias("position"), (kind != "purchase").alias("playing"))


@query(f"""
WITH RECURSIVE p AS (SELECT *, floor(epoch_us(ts) / 1000 / 3600000)::BIGINT AS tick FROM ({PLAYED})),
a AS (SELECT user_id, tick, last_value(CASE WHEN track = 'main' THEN position END IGNORE NULLS) OVER w AS main, last_value(CASE WHEN track = 'sub' THEN position END IGNORE NULLS) OVER w AS sub,
  last_value(CASE WHEN track = 'sub' THEN playing END IGNORE NULLS) OVER w AS plays, count(*) FILTER (track = 'sub') OVER w AS since, row_number() OVER (PARTITION BY user_id, tick ORDER BY ts DESC, event_id DESC) AS n FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, since ORDER BY tick) AS k FROM a WHERE n = 1 AND plays AND main IS NOT NULL AND sub IS NOT NULL),
r AS (SELECT user_id, since, k, tick, main, sub, abs(main - sub) > 20 AS gap FROM t WHERE k = 1
  UNION ALL SELECT t.user_id, t.since, t.k, t.tick, t.main, CASE WHEN r.gap THEN r.main ELSE r.sub END, abs(t.main - CASE WHEN r.gap THEN r.main ELSE r.sub END) > 20 FROM r JOIN t ON t.user_id = r.user_id AND t.since = r.since AND t.k = r.k + 1)
SELECT user_id, tick, main, sub FROM r WHERE gap""")
def drift_ticks(spark, sf_dir):
    """Ticks of an hour, for events are sparse."""
    return sequences.drift_ticks(_played(_table(spark, sf_dir, "events")), 20, 3_600_000, "user_id")


@query(f"""
WITH p AS (SELECT * FROM ({PLAYED})),
w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, arg_max(position, (ts, event_id)) FILTER (track = 'main') AS main, arg_max(position, (ts, event_id)) FILTER (track = 'sub') AS sub,
  arg_max(playing, (ts, event_id)) FILTER (track = 'sub') AS plays FROM p GROUP BY 1, 2)
SELECT user_id, epoch_ms(day) AS day_ms, main, sub FROM w WHERE plays AND abs(main - sub) > 20 AND day + INTERVAL 1 DAY <= (SELECT max(ts) FROM p) - INTERVAL 1 SECOND""")
def stream_drift(spark, sf_dir):
    """The stream of positions to its end, in ticks of a day; the ticks that the watermark has passed."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.stream_drift(_played(e).withColumnRenamed("user_id", "session_id"), 20, "1 day")
    return _drained(found.select(F.col("session_id").alias("user_id"), F.unix_millis("window.start").alias("day_ms"), "main", "sub"), "append")


def _ops(spark, sf_dir):
    kind = F.col("event_type")
    op = F.when(kind == "error", "pop").when(kind == "signup", "remove").otherwise("push")
    order = F.struct("ts", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", order.alias("o"), op.alias("op"), F.when(kind == "signup", "view").otherwise(kind).alias("key")).selectExpr(
        "user_id", "unix_micros(timestamp(o.ts)) * 1000 + o.event_id % 1000 AS seq", "op", "key")


# Each event is a list of one key, so that a fold over lists can carry the history.
FOLD = "SELECT user_id, list_reduce(list_prepend([]::VARCHAR[], list([event_type] ORDER BY ts, event_id)), lambda a, b: {step}) AS history FROM events GROUP BY user_id"
PUSH = "CASE WHEN len(a) > 0 AND a[len(a)] = b[1] THEN a ELSE list_concat(a, b) END"
REPLAYED = FOLD.format(step=f"""CASE b[1] WHEN 'error' THEN a[1:greatest(len(a) - 1, 0)]
  WHEN 'signup' THEN list_filter(list_filter(a, lambda x: x <> 'view'), lambda x, i: i = 1 OR x <> list_filter(a, lambda y: y <> 'view')[i - 1]) ELSE {PUSH} END""")
TRAILED = FOLD.format(step="""CASE b[1] WHEN 'error' THEN a[1:greatest(len(a) - 1, 0)] WHEN 'signup' THEN CASE WHEN list_contains(a, 'view') THEN a[1:list_position(a, 'view')] ELSE a END
  ELSE CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END END""")


@query(REPLAYED)
def replay_history(spark, sf_dir):
    return sequences.replay_history(_ops(spark, sf_dir))


@query(FOLD.format(step=f"""CASE b[1] WHEN 'error' THEN a[1:greatest(len(a) - 1, 1)]
  WHEN 'signup' THEN list_filter(list_prepend(a[1], list_filter(a[2:], lambda x: x <> 'view')), lambda x, i: i = 1 OR x <> list_prepend(a[1], list_filter(a[2:], lambda y: y <> 'view'))[i - 1]) ELSE {PUSH} END""").replace("list_prepend([]::VARCHAR[], list", "list_prepend(['view'], list"))
def replay_from_default(spark, sf_dir):
    """Histories over a default entry, which neither a pop nor a removal takes."""
    return sequences.replay_history(_ops(spark, sf_dir), default="view")


@query(TRAILED)
def breadcrumb_trail(spark, sf_dir):
    return sequences.breadcrumb_trail(_ops(spark, sf_dir).withColumn("op", F.when(F.col("op") == "remove", "select").otherwise(F.col("op"))))


@query("""
WITH e AS (SELECT user_id, list(event_type IN ('view', 'click') ORDER BY ts, event_id) AS ups FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(1.0::DOUBLE, list_transform(ups, lambda u: CASE WHEN u THEN 1.25 ELSE 0.8 END::DOUBLE)), lambda a, b: greatest(0.1, least(10.0, a * b))), 6) AS zoom FROM e""")
def clamped_running_product(spark, sf_dir):
    e = _events(spark, sf_dir, "user_id", "ts", "event_id", "event_type").withColumn("up", F.col("event_type").isin("view", "click"))
    return sequences.clamped_running_product(e, "user_id", ["ts", "event_id"], "up").withColumn("zoom", F.round("zoom", 6))


# Jobs, modes, budgets

JOBS = "SELECT o_orderpriority AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, 'order-' || o_orderkey AS file, 'customer ' || o_custkey AS reason FROM orders"
STATUS = f"SELECT batch_id, count(*) AS total, count(*) FILTER (status <> 'pending') AS processed, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, floor(count(*) FILTER (status <> 'pending') / count(*) * 100)::INTEGER AS percentage FROM ({JOBS}) GROUP BY batch_id"


def _as_jobs(orders: DataFrame) -> DataFrame:
    s = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderpriority").alias("batch_id"), F.when(s == "F", "success").when(s == "O", "failed").otherwise("pending").alias("status"),
        F.concat(F.lit("order-"), "o_orderkey").alias("file"), F.concat(F.lit("customer "), "o_custkey").alias("reason"))


@query(STATUS)
def job_status(spark, sf_dir):
    return aggregates.job_status(_as_jobs(_table(spark, sf_dir, "orders")))


@query(f"SELECT batch_id, total - 10 AS total, least(processed, total - 10) AS processed, least(success, least(processed, total - 10)) AS success FROM ({STATUS})")
def clamp_counters(spark, sf_dir):
    s = aggregates.job_status(_as_jobs(_table(spark, sf_dir, "orders"))).select("batch_id", (F.col("total") - 10).alias("total"), "processed", "success")
    return aggregates.clamp_counters(s)


@query(f"SELECT batch_id, file || ': ' || reason AS line FROM ({JOBS}) WHERE status = 'failed'")
def failure_report(spark, sf_dir):
    return aggregates.failure_report(_as_jobs(_table(spark, sf_dir, "orders")))


@query(f"SELECT batch_id, list(file || ': ' || reason ORDER BY ts, file) AS lines FROM (SELECT o_orderpriority AS batch_id, o_orderstatus, 'order-' || o_orderkey AS file, 'customer ' || o_custkey AS reason, o_orderdate AS ts FROM orders) WHERE o_orderstatus = 'O' GROUP BY batch_id")
def failure_lists(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    ts = o.select(F.concat(F.lit("order-"), "o_orderkey").alias("file"), F.col("o_orderdate").alias("ts"))
    return aggregates.failure_lists(_as_jobs(o).join(ts, "file"))


@query(STATUS)
def stream_job_status(spark, sf_dir):
    """The stream of orders to its end; the counts equal those of job_status."""
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return _drained(streams.stream_job_status(_as_jobs(spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*"))), "complete")


@query(FOLD.format(step=f"CASE b[1] WHEN 'error' THEN a[1:greatest(len(a) - 1, 1)] ELSE {PUSH} END").replace("list_prepend([]::VARCHAR[], list", "list_prepend(['view'], list").replace(
    "FROM events", "FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 1000"))
def stream_history(spark, sf_dir):
    """The stream of events to its end, over a default entry: each user's last history, of the rows that the watermark has passed."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type") == "error", "pop").otherwise("push")
    ops = e.select("user_id", (F.unix_micros("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), "ts", op.alias("op"), F.col("event_type").alias("key"))
    return _drained(streams.stream_history(ops, default="view"), "update", ["user_id"], streams.ROCKS)


def _drained(stream: DataFrame, mode: str, key: list[str] | None = None, store: str | None = None) -> DataFrame:
    """What a stream over a bounded table has given when it is at its end, written batch by batch to the shared folder; in update mode the last row of each ``key``.

    ``store`` keeps the stream's state; the session's own setting is put back when the stream has begun.
    """
    spark = stream.sparkSession
    path = new_path(spark)
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    # Appended and updated rows are kept of every batch, under its number, so that a repeated batch replaces itself; complete mode keeps the last batch.
    out = (lambda n: f"{path}/out") if mode == "complete" else lambda n: f"{path}/out/batch={n}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, store or before)
    try:
        running = write.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out(n))).start()
    finally:
        spark.conf.set(setting, before)
    running.awaitTermination()
    if mode == "update":
        rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
        return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(stream.columns)


@query("""
WITH c AS (SELECT o_custkey, (year(o_orderdate) // 2) * 2 AS low, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, low, low + 2 AS high, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, low) = 1""")
def bucket_mode(spark, sf_dir):
    return aggregates.bucket_mode(_table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")), "o_custkey", "y", 2)


ITEMS = "SELECT conv_id AS group_id, turn AS pos, length(text) AS size FROM conversations"


def _items(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("size"))


def _ranged_items(spark, sf_dir):
    return ranged(_items(spark, sf_dir), "group_id", ["pos"])


@query(f"SELECT group_id, pos, size, sum(size) OVER g <= 800 OR row_number() OVER b = 1 OR sum(size) OVER b + 20 <= 800 AS shown FROM ({ITEMS}) WINDOW g AS (PARTITION BY group_id), b AS (PARTITION BY group_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)")
def fit_budget_tail(spark, sf_dir):
    return aggregates.fit_budget_tail(_ranged_items(spark, sf_dir), 800, 20).select("group_id", "pos", "size", "shown")


@query(f"SELECT group_id, pos, size, sum(size) OVER g + 4 * (count(*) OVER g - 1) <= 800 OR 30 + sum(size) OVER b + 4 * (count(*) OVER b - 1) <= 800 AS shown FROM ({ITEMS}) WINDOW g AS (PARTITION BY group_id), b AS (PARTITION BY group_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def fit_budget_head(spark, sf_dir):
    return aggregates.fit_budget_head(_ranged_items(spark, sf_dir), 800, 30, 4).select("group_id", "pos", "size", "shown")


@query(f"SELECT group_id, pos, size, sum(size) OVER g + 30 + 4 * count(*) OVER g <= 800 OR 30 + sum(size) OVER b + 4 * (count(*) OVER b - 1) <= 800 AS shown FROM ({ITEMS}) WINDOW g AS (PARTITION BY group_id), b AS (PARTITION BY group_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def fit_budget_head_hidden(spark, sf_dir):
    """With hidden entries, for which the button counts as an item."""
    return aggregates.fit_budget_head(_ranged_items(spark, sf_dir), 800, 30, 4, hidden=True).select("group_id", "pos", "size", "shown")


@query(f"SELECT group_id, (sum(size) + 4 * (count(*) - 1))::BIGINT AS need FROM ({ITEMS}) GROUP BY group_id")
def budget_need(spark, sf_dir):
    return aggregates.budget_need(_items(spark, sf_dir), "group_id", "size", 4)


# Some items have no height; a row of such items takes any number of them.
@query(f"""
WITH RECURSIVE i AS (SELECT *, pos * 7 % 4 * 5 AS height, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS n FROM ({ITEMS})),
p AS (SELECT group_id, pos, size, height, n, 0::BIGINT AS row, 0::BIGINT AS x, height > 0 AS high FROM i WHERE n = 1
  UNION ALL SELECT i.group_id, i.pos, i.size, i.height, i.n, CASE WHEN p.high AND p.x + p.size + 4 + i.size > 800 THEN p.row + 1 ELSE p.row END,
    CASE WHEN p.high AND p.x + p.size + 4 + i.size > 800 THEN 0 ELSE p.x + p.size + 4 END, CASE WHEN p.high AND p.x + p.size + 4 + i.size > 800 THEN i.height > 0 ELSE p.high OR i.height > 0 END
  FROM p JOIN i ON i.group_id = p.group_id AND i.n = p.n + 1),
r AS (SELECT group_id, row, max(height) AS row_height FROM p GROUP BY 1, 2), y AS (SELECT *, sum(row_height + 6) OVER (PARTITION BY group_id ORDER BY row) - row_height - 6 AS y FROM r)
SELECT group_id, pos, size, height, row, x::DOUBLE AS x, y::DOUBLE AS y, row_height::DOUBLE AS row_height FROM p JOIN y USING (group_id, row)""")
def pack_rows(spark, sf_dir):
    return sequences.pack_rows(_items(spark, sf_dir).withColumn("height", F.col("pos") * 7 % 4 * 5), 800, 4, 6)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY first) AS joined FROM (SELECT conv_id, text, min(turn) AS first FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY conv_id")
def ordered_distinct_concat(spark, sf_dir):
    return aggregates.ordered_distinct_concat(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(r"""
WITH t AS (SELECT conv_id, turn, text, text || CASE turn % 3 WHEN 0 THEN chr(10) || ' ' WHEN 1 THEN '' ELSE ' .' END AS fresh FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN regexp_replace(text, '\s+$', '') = regexp_replace(fresh, '\s+$', '') THEN text ELSE fresh END) AS text_md5 FROM t""")
def restyled(spark, sf_dir):
    k = F.col("turn") % 3
    fresh = F.concat("text", F.when(k == 0, "\n ").when(k == 1, "").otherwise(" ."))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.restyled(F.col("text"), fresh)).alias("text_md5"))


# Colours and numbers

RGB = "SELECT DISTINCT l_orderkey % 256 AS r, l_partkey % 256 AS g, l_suppkey % 256 AS b FROM lineitem"
HSV = f"""SELECT r, g, b, CASE WHEN d = 0 THEN 0.0 WHEN hi = r THEN fmod(60 * ((g - b)::DOUBLE / d) + 360, 360) WHEN hi = g THEN fmod(60 * ((b - r)::DOUBLE / d) + 120, 360) ELSE fmod(60 * ((r - g)::DOUBLE / d) + 240, 360) END AS h,
  CASE WHEN hi = 0 THEN 0.0 ELSE d::DOUBLE / hi END AS s, hi / 255.0::DOUBLE AS v FROM (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM ({RGB}))"""


def _rgb(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 256 AS r", "l_partkey % 256 AS g", "l_suppkey % 256 AS b").distinct()


def _hsv(spark, sf_dir):
    return _rgb(spark, sf_dir).withColumn("c", color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))


@query(f"SELECT r, g, b, round(h, 9) AS h, round(s, 9) AS s, round(v, 9) AS v FROM ({HSV})")
def rgb_to_hsv(spark, sf_dir):
    return _hsv(spark, sf_dir).select("r", "g", "b", *[F.round(f"c.{x}", 9).alias(x) for x in "hsv"])


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 360)::DOUBLE AS h, (l_suppkey % 101) / 101.0::DOUBLE AS s, (l_orderkey % 97) / 97.0::DOUBLE AS v FROM lineitem),
y AS (SELECT *, floor(h / 60)::BIGINT % 6 AS k, h / 60 - floor(h / 60) AS f FROM x), z AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM y)
SELECT l_orderkey, l_linenumber, trunc(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END * 255)::INTEGER AS r,
  trunc(CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END * 255)::INTEGER AS g, trunc(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END * 255)::INTEGER AS b FROM z""")
def hsv_to_rgb(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "double(l_partkey * 7 % 360) h", "(l_suppkey % 101) / 101D s", "(l_orderkey % 97) / 97D v")
    return x.withColumn("c", color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))).select("l_orderkey", "l_linenumber", "c.*")


@query(f"SELECT r, g, b, round(h, 9) AS h, round(s, 9) AS s, round(v * CASE WHEN v > 0.9 THEN 0.8 WHEN v > 0.8 THEN 0.9 WHEN v > 0.7 THEN 0.95 ELSE 1.0 END, 9) AS v FROM ({HSV})")
def adjust_brightness(spark, sf_dir):
    x = _hsv(spark, sf_dir).withColumn("c", color.adjust_brightness(F.col("c")))
    return x.select("r", "g", "b", *[F.round(f"c.{n}", 9).alias(n) for n in "hsv"])


@query(f"SELECT r, g, b, round(0.3 * sqrt((r - g) * (r - g) + (0.5 * (r + g) - b) * (0.5 * (r + g) - b)), 6) AS colorfulness FROM ({RGB})")
def colorfulness(spark, sf_dir):
    return _rgb(spark, sf_dir).withColumn("colorfulness", F.round(color.colorfulness(F.col("r"), F.col("g"), F.col("b")), 6))


@query(f"""
WITH f(shade, a, c) AS (VALUES ('primary', 1.0, 1.0), ('dark1', 1.0, 0.75), ('dark2', 1.05, 0.5), ('dark3', 1.1, 0.4), ('light1', 1.0, 1.05), ('light2', 0.75, 1.05), ('light3', 0.65, 1.05))
SELECT r, g, b, shade, round(least(s * a::DOUBLE, 1.0), 9) AS s, round(least(v * c::DOUBLE, 1.0), 9) AS v FROM ({HSV}), f""")
def theme_shades(spark, sf_dir):
    x = _hsv(spark, sf_dir).select("r", "g", "b", F.explode(color.theme_shades(F.col("c.h"), F.col("c.s"), F.col("c.v"))).alias("t"))
    return x.select("r", "g", "b", "t.shade", F.round("t.s", 9).alias("s"), F.round("t.v", 9).alias("v"))


DARK = "VALUES ('primary', 1.0, 1.0), ('dark1', 1.0, 0.9), ('dark2', 0.977, 0.82), ('dark3', 0.95, 0.7), ('light1', 0.92, 1.0), ('light2', 0.78, 1.0), ('light3', 0.65, 1.0)"


@query(f"""
WITH f(shade, a, c) AS ({DARK})
SELECT r, g, b, shade, round(least(s * 0.84::DOUBLE * a::DOUBLE, 1.0), 9) AS s, round(least(c::DOUBLE, 1.0), 9) AS v FROM ({HSV}), f""")
def theme_shades_dark(spark, sf_dir):
    x = _hsv(spark, sf_dir).select("r", "g", "b", F.explode(color.theme_shades(F.col("c.h"), F.col("c.s"), F.col("c.v"), dark=True)).alias("t"))
    return x.select("r", "g", "b", "t.shade", F.round("t.s", 9).alias("s"), F.round("t.v", 9).alias("v"))


@query(f"""
WITH f(shade, a, c) AS ({DARK}),
x AS (SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 2))::INTEGER AS r, ('0x' || substr(md5(p_name), 3, 2))::INTEGER AS g, ('0x' || substr(md5(p_name), 5, 2))::INTEGER AS b FROM part),
d AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM x),
y AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN hi = r THEN fmod(60 * ((g - b)::DOUBLE / d) + 360, 360) WHEN hi = g THEN fmod(60 * ((b - r)::DOUBLE / d) + 120, 360) ELSE fmod(60 * ((r - g)::DOUBLE / d) + 240, 360) END AS h,
  least(CASE WHEN hi = 0 THEN 0.0 ELSE d::DOUBLE / hi END * 0.84::DOUBLE * a::DOUBLE, 1.0) AS s, least(c::DOUBLE, 1.0) AS v FROM d, f),
z AS (SELECT *, floor(h / 60)::BIGINT % 6 AS k, v * (1 - s) AS p, v * (1 - (h / 60 - floor(h / 60)) * s) AS q, v * (1 - (1 - (h / 60 - floor(h / 60))) * s) AS t FROM y)
SELECT p_partkey, shade, round(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END * 255)::INTEGER AS red,
  round(CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END * 255)::INTEGER AS green, round(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END * 255)::INTEGER AS blue FROM z""")
def shade_colors(spark, sf_dir):
    text_ = F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))
    x = _table(spark, sf_dir, "part").select("p_partkey", F.explode(color.shade_colors(text_, "#000000", dark=True)).alias("t"))
    return x.select("p_partkey", "t.shade", F.col("t.r").alias("red"), F.col("t.g").alias("green"), F.col("t.b").alias("blue"))


@query(f"""
WITH y AS (SELECT r, g, b, trunc(255 * 10 / 255.0::DOUBLE + r * 245 / 255.0::DOUBLE)::INTEGER AS r1, trunc(255 * 10 / 255.0::DOUBLE + g * 245 / 255.0::DOUBLE)::INTEGER AS g1, trunc(255 * 10 / 255.0::DOUBLE + b * 245 / 255.0::DOUBLE)::INTEGER AS b1 FROM ({RGB}))
SELECT r, g, b, trunc(242 * 150 / 255.0::DOUBLE + r1 * 105 / 255.0::DOUBLE)::INTEGER AS over_r, trunc(242 * 150 / 255.0::DOUBLE + g1 * 105 / 255.0::DOUBLE)::INTEGER AS over_g, trunc(242 * 150 / 255.0::DOUBLE + b1 * 105 / 255.0::DOUBLE)::INTEGER AS over_b FROM y""")
def blend_layers(spark, sf_dir):
    layer = lambda *v: F.struct(*[F.lit(x).alias(c) for x, c in zip(v, "rgba", strict=True)])
    out = color.blend_layers(F.struct("r", "g", "b"), layer(255, 255, 255, 10), layer(242, 242, 242, 150))
    return _rgb(spark, sf_dir).withColumn("x", out).select("r", "g", "b", *[F.col(f"x.{c}").alias(f"over_{c}") for c in "rgb"])


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || upper(substr(md5(p_name), 1, 6)) WHEN 1 THEN '#' || substr(md5(p_name), 1, 8) WHEN 2 THEN p_name ELSE NULL END AS t FROM part),
y AS (SELECT p_partkey, CASE WHEN regexp_full_match(t, '#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})') THEN lpad(replace(t, '#', ''), 8, 'F') ELSE 'FF102030' END AS h FROM x)
SELECT p_partkey, ('0x' || substr(h, 3, 2))::INTEGER AS r, ('0x' || substr(h, 5, 2))::INTEGER AS g, ('0x' || substr(h, 7, 2))::INTEGER AS b, ('0x' || substr(h, 1, 2))::INTEGER AS a FROM y""")
def parse_hex_color(spark, sf_dir):
    k, m = F.col("p_partkey") % 4, F.md5("p_name")
    t = F.when(k == 0, F.concat(F.lit("#"), F.upper(F.substring(m, 1, 6)))).when(k == 1, F.concat(F.lit("#"), F.substring(m, 1, 8))).when(k == 2, F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", color.parse_hex_color(t, "#102030").alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, trunc(p_partkey % 101 / 100.0::DOUBLE * 255)::INTEGER AS alpha, trunc(p_partkey % 256 / 255.0::DOUBLE * 100)::INTEGER AS percent FROM part")
def alpha_percent(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", color.alpha_from_percent(k % 101).alias("alpha"), color.percent_from_alpha(k % 256).alias("percent"))


@query(f"SELECT r, g, b, trunc(g * b / 255.0::DOUBLE + r * (255 - b) / 255.0::DOUBLE)::INTEGER AS blended FROM ({RGB})")
def alpha_blend(spark, sf_dir):
    return _rgb(spark, sf_dir).withColumn("blended", color.alpha_blend(F.col("r"), F.col("g"), F.col("b")))


@query("SELECT p_partkey, trunc((p_size - 1) / greatest(49, 1)::DOUBLE * 320)::INTEGER AS pos, trunc((p_partkey % 340 - 10)::DOUBLE / 320 * 49 + 1)::INTEGER AS value FROM part")
def slider_position(spark, sf_dir):
    n = lambda x: F.lit(x)
    return _table(spark, sf_dir, "part").select(
        "p_partkey", color.value_to_position(F.col("p_size"), n(1), n(50), n(320)).alias("pos"), color.position_to_value(F.col("p_partkey") % 340, n(1), n(50), n(320), n(20)).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 60 <= 5 THEN '' ELSE p_size || ' of ' || (p_partkey % 60 - 5) || ': ' || trunc((p_size - 5) * 100 / (p_partkey % 60 - 5)::DOUBLE)::INTEGER || '%' END AS label FROM part")
def progress_text(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", color.progress_text(F.col("p_size"), F.lit(5), F.col("p_partkey") % 60, F.lit("%v of %m: %p%")).alias("label"))


@query("""
WITH x AS (SELECT p_partkey, p_size * 20 AS w, p_partkey % 700 + 1 AS h FROM part)
SELECT p_partkey, trunc(w * least(450 / w::DOUBLE, 450 / h::DOUBLE, 1.0))::INTEGER AS fit_w, trunc(h * least(450 / w::DOUBLE, 450 / h::DOUBLE, 1.0))::INTEGER AS fit_h, greatest(trunc(w * 120 / h::DOUBLE)::INTEGER, 1) AS side_w, greatest(trunc(h * 120 / w::DOUBLE)::INTEGER, 1) AS side_h,
  trunc(w * greatest(96 / w::DOUBLE, 96 / h::DOUBLE))::INTEGER AS cover_w, trunc(h * greatest(96 / w::DOUBLE, 96 / h::DOUBLE))::INTEGER AS cover_h,
  trunc((trunc(w * greatest(96 / w::DOUBLE, 96 / h::DOUBLE)) - 96) / 2)::INTEGER AS cover_x, trunc((trunc(h * greatest(96 / w::DOUBLE, 96 / h::DOUBLE)) - 96) / 2)::INTEGER AS cover_y FROM x""")
def image_sizes(spark, sf_dir):
    """fit_within, scale_to_side and center_crop_box."""
    x = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 20 AS w", "p_partkey % 700 + 1 AS h")
    w, h = F.col("w"), F.col("h")
    x = x.select("p_partkey", color.fit_within(w, h, F.lit(450), F.lit(450)).alias("f"), color.scale_to_side(w, h, 120).w.alias("side_w"), color.scale_to_side(w, h, 120, "width").h.alias("side_h"), color.center_crop_box(w, h, 96).alias("c"))
    return x.select("p_partkey", F.col("f.w").alias("fit_w"), F.col("f.h").alias("fit_h"), "side_w", "side_h", F.col("c.w").alias("cover_w"), F.col("c.h").alias("cover_h"), F.col("c.x").alias("cover_x"), F.col("c.y").alias("cover_y"))


# Grays and pure reds are among the colours: every third row's green and blue are equal, some rows' red too.
PALETTES = """SELECT l_orderkey AS image_id, l_linenumber AS pos, l_partkey % 256 AS r, CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 256 ELSE l_suppkey % 256 END AS g,
  CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 256 WHEN l_suppkey % 3 = 0 THEN l_suppkey % 256 ELSE l_orderkey % 256 END AS b FROM lineitem"""


@query(f"""
WITH p AS ({PALETTES}), d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pos, r, g, b) AS n, greatest(r, g, b) AS hi, greatest(r, g, b) / 255.0::DOUBLE - least(r, g, b) / 255.0::DOUBLE AS d, r / 255.0::DOUBLE AS r1, g / 255.0::DOUBLE AS g1, b / 255.0::DOUBLE AS b1 FROM p),
h AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN hi = r THEN fmod(60 * ((g1 - b1) / d) + 360, 360) WHEN hi = g THEN fmod(60 * ((b1 - r1) / d) + 120, 360) ELSE fmod(60 * ((r1 - g1) / d) + 240, 360) END AS h,
  CASE WHEN hi = 0 THEN 0.0 ELSE d / (hi / 255.0::DOUBLE) END AS s, hi / 255.0::DOUBLE AS v0 FROM d),
a AS (SELECT *, v0 * CASE WHEN v0 > 0.9 THEN 0.8 WHEN v0 > 0.8 THEN 0.9 WHEN v0 > 0.7 THEN 0.95 ELSE 1.0 END::DOUBLE AS v, floor(h / 60)::BIGINT % 6 AS k, h / 60 - floor(h / 60) AS f FROM h),
z AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM a),
c AS (SELECT image_id, n, pos, trunc(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END * 255)::INTEGER AS r,
  trunc(CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END * 255)::INTEGER AS g, trunc(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END * 255)::INTEGER AS b FROM z),
l AS (SELECT image_id, list({{'pos': pos, 'r': r, 'g': g, 'b': b, 'plain': g = b AND r >= g}} ORDER BY n) AS x FROM c GROUP BY image_id),
-- One colour after the other: it goes if it is plain and no earlier removal has left two.
w AS (SELECT image_id, list_filter(x, lambda e, i: NOT e.plain OR (len(list_filter(x[1:i - 1], lambda y: y.plain)) > 0 AND len(x) - len(list_filter(x[1:i - 1], lambda y: y.plain)) <= 2))[1:5] AS x FROM l),
u AS (SELECT image_id, unnest(CASE WHEN len(x) = 0 THEN [{{'pos': NULL, 'r': 24, 'g': 24, 'b': 24, 'plain': true}}] ELSE x END) AS e, unnest(range(greatest(len(x), 1))) AS i FROM w)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY round(0.3 * sqrt((e.r - e.g) * (e.r - e.g) + (0.5 * (e.r + e.g) - e.b) * (0.5 * (e.r + e.g) - e.b)), 9) DESC, i)::INTEGER AS rank, e.pos, e.r, e.g, e.b FROM u""")
def palette_rank(spark, sf_dir):
    c = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", "l_linenumber AS pos", "l_partkey % 256 AS r", "CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 256 ELSE l_suppkey % 256 END AS g",
        "CASE WHEN l_suppkey % 5 = 0 THEN l_partkey % 256 WHEN l_suppkey % 3 = 0 THEN l_suppkey % 256 ELSE l_orderkey % 256 END AS b")
    return aggregates.palette_rank(c)


# Dates

@query("""
SELECT o_orderkey, (year(d) - 1990) * 12 + month(d) - 1 AS page, date_trunc('month', d)::DATE AS first, last_day(d) AS last, day(last_day(d))::INTEGER AS days,
  (date_diff('day', DATE '1990-01-01', d) // 7)::INTEGER AS row, (date_diff('day', DATE '1990-01-01', d) % 7)::INTEGER AS col, strftime(d, '%B') AS month_name, lpad(day(d)::VARCHAR, 2, '0') AS day2, year(d) || '年' AS year_text
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def calendar(spark, sf_dir):
    """month_page and back, calendar_cell (1 January 1990 is a Monday), days_in_month, month names, suffixes, padding."""
    d = F.to_date("o_orderdate")
    x = _table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), dates.month_page(d, 1990).alias("page"), dates.calendar_cell(d, 1990).alias("c"))
    d = F.col("d")
    return x.select(
        "o_orderkey", "page", dates.page_month(F.col("page"), 1990).alias("first"), F.last_day(d).alias("last"), dates.days_in_month(F.year(d), F.month(d)).alias("days"), "c.row", "c.col",
        dates.encode_month(dates.decode_month(dates.encode_month(F.month(d)))).alias("month_name"), dates.pad2(F.day(d)).alias("day2"),
        dates.encode_suffix(dates.decode_suffix(dates.encode_suffix(F.year(d), "年")), "年").alias("year_text"))


@query("""
SELECT o_orderkey, floor(n / 7.0)::INTEGER AS row, (n - 7 * floor(n / 7.0))::INTEGER AS col FROM (SELECT o_orderkey, date_diff('day', DATE '1993-01-01', o_orderdate::DATE) + 4 AS n FROM orders)""")
def calendar_cell(spark, sf_dir):
    """From 1 January 1993, a Friday; earlier days stand in rows above the first."""
    d = F.to_date("o_orderdate")
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.calendar_cell(d, 1993).alias("c")).select("o_orderkey", "c.row", "c.col")


@query("""
SELECT o_orderkey, strftime(d, '%B') AS month_shown, month(d)::INTEGER AS month_back, day(d) || '日' AS day_shown, day(d)::INTEGER AS day_back, lpad(day(d)::VARCHAR, 2, '0') AS padded, year(d)::VARCHAR AS digits FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def column_formatters(spark, sf_dir):
    """What a picker shows of a date, and back."""
    d = F.to_date("o_orderdate")
    shown = {"month_shown": hooks.encode(F.month(d), "month"), "day_shown": hooks.encode(F.day(d), "day_suffix"), "padded": hooks.encode(F.day(d), "pad2"), "digits": hooks.encode(F.year(d), "digit")}
    x = _table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in shown.items()])
    return x.withColumn("month_back", hooks.decode(F.col("month_shown"), "month")).withColumn("day_back", hooks.decode(F.col("day_shown"), "day_suffix"))


@query("""
SELECT event_id, CASE WHEN k > 60 THEN -1 ELSE 60 // greatest(k, 1) END::BIGINT AS share, CASE WHEN k > 60 THEN 'ValueError: ' || k || ' is over 60' END AS reason FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)""")
def with_default(spark, sf_dir):
    """A rule that fails for some rows: these get the default, and say why."""
    rule = hooks.with_default(_share, "long", -1)
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").select("event_id", rule(k).alias("x")).select("event_id", F.col("x.value").alias("share"), F.col("x.error").alias("reason"))


@query("""
SELECT event_id, coalesce(CASE WHEN k % 7 <> 0 THEN (value * 100)::BIGINT // (k % 7) END, -1)::BIGINT AS share, CASE WHEN k % 7 = 0 THEN 'no parts in ' || k END AS reason
FROM (SELECT event_id, trunc(value)::BIGINT AS value, (props->>'k')::BIGINT AS k FROM events)""")
def or_default(spark, sf_dir):
    """A division that fails for some rows, without Python."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = _table(spark, sf_dir, "events").select("event_id", k.alias("k"), (F.col("value").cast("long") * 100).alias("value"))
    share = F.expr("CASE WHEN k % 7 <> 0 THEN value div (k % 7) END")
    return e.select("event_id", hooks.or_default(share, -1, F.concat(F.lit("no parts in "), "k")).alias("x")).select("event_id", F.col("x.value").alias("share"), F.col("x.error").alias("reason"))


def _share(k: int) -> int:
    if k > 60:
        raise ValueError(f"{int(k)} is over 60")
    return 60 // max(int(k), 1)


@query("""
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders)
SELECT month, i AS cell, (date_trunc('week', month)::DATE + i::INTEGER) AS day FROM m, range(42) t(i)""")
def calendar_grid(spark, sf_dir):
    m = _table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).distinct()
    return m.select("month", F.posexplode(dates.calendar_grid(F.col("month"))).alias("cell", "day")).withColumn("cell", F.col("cell").cast("long"))


@query("""
SELECT event_id, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END::INTEGER AS hour12, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS half, hour(ts)::INTEGER AS hour24,
  (event_id * 977 // 3600) || ':' || lpad((event_id * 977 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id * 977 % 60)::VARCHAR, 2, '0') AS duration FROM events""")
def clock(spark, sf_dir):
    """to_12h, from_12h and format_duration."""
    x = _table(spark, sf_dir, "events").select("event_id", dates.to_12h(F.hour("ts")).alias("t"), dates.format_duration(F.col("event_id") * 977_000 + 999).alias("duration"))
    return x.select("event_id", F.col("t.hour").alias("hour12"), "t.half", dates.from_12h(F.col("t.hour"), F.col("t.half")).alias("hour24"), "duration")


# Text

# DuckDB's upper maps a character to one character, and knows the letters of Unicode 15; these have more, or came with Unicode 16.
UPPER = {c: c.upper() for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {chr(a): chr(b) for a, b in zip(
    [0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)], [0xA7DC, 0xA7CB, 0x1C89, 0xA7CC, 0xA7DA, *range(0x10D50, 0x10D66)], strict=True)}
INITIAL = "nullif(CASE substr(text, 1, 1) " + " ".join(f"WHEN '{c}' THEN '{u}'" for c, u in UPPER.items()) + " ELSE upper(substr(text, 1, 1)) END, '')"


@query(f"SELECT doc_id, length(text) + length(regexp_replace(text, '[^{text.wide_class()}]', '', 'g')) AS width, {INITIAL} AS initial FROM documents")
def display_width(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.display_width(F.col("text")).cast("long").alias("width"), text.initial_letter(F.col("text")).alias("initial"))


@query("SELECT page_id, trim(regexp_replace(html, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]+', ' ', 'g'), ' ') AS clean FROM pages")
def normalize_whitespace(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.normalize_whitespace(F.col("html")).alias("clean"))


@query("SELECT conv_id, turn, len(string_split(replace(text, chr(10), ' '), ' ')) * 2 - 1 - len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x = '')) + CASE WHEN text = '' THEN 1 ELSE 0 END AS tokens FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE text IS NULL")
def tokenize(spark, sf_dir):
    tokens = text.tokenize(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(tokens.isNotNull(), F.size(tokens)).cast("long").alias("tokens"))


@query("SELECT p_partkey, list_transform(range(0, length(p_name), 7), lambda i: substr(p_name, i + 1, 7)) AS pieces FROM part")
def split_long_token(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.split_long_token(F.col("p_name"), 7).alias("pieces"))


@query("SELECT item_id, kind, count(*) AS n FROM (SELECT item_id, CASE WHEN regexp_full_match(unnest(string_split(text, '')), '\\s') THEN 'SPACE' ELSE 'LATIN' END AS kind FROM benchmark) GROUP BY item_id, kind")
def char_type(spark, sf_dir):
    c = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return c.groupBy("item_id", text.char_type(F.col("c")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name || ': --Mark-blue, --' || c_custkey || ', red, --Mainly, --unknown, --red, --{Main' AS style FROM customer")
def render_template(spark, sf_dir):
    """Values that hold a slot's name stay as they are."""
    t = F.concat("c_name", F.lit(": --Main, ----"), "c_custkey", F.lit(", --{Mark}, --Mainly, --unknown, ------Mark, --{Main"))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.render_template(t, {"Main": "--Mark-blue", "Mark": "red"}).alias("style"))


# Each line is cut into words and single spaces, and these are folded into (rows that are closed, open row). All characters of the table take one column.
WRAPPED = r"""
WITH d AS (SELECT doc_id, text, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, text, unnest(raw) AS raw, unnest(range(len(raw))) AS pos FROM d),
n AS (SELECT doc_id, text, pos, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ') AS line FROM l),
t AS (SELECT *, list_transform(regexp_extract_all(line, ' |[^ ]+'), lambda x: ['', x]) AS tokens FROM n),
f AS (SELECT doc_id, text, pos, line, CASE WHEN length(line) > 80 THEN list_reduce(list_prepend(['', ''], tokens), lambda a, b:
  CASE WHEN b[2] = ' ' AND a[2] = '' THEN a
  WHEN length(a[2]) + length(b[2]) = 80 THEN [a[1] || rtrim(a[2] || b[2], ' ') || chr(10), '']
  WHEN length(a[2]) + length(b[2]) < 80 THEN [a[1], a[2] || b[2]]
  ELSE [a[1] || CASE WHEN a[2] <> '' THEN rtrim(a[2], ' ') || chr(10) ELSE '' END || list_aggregate(list_prepend('', list_transform(range(0, (length(b[2]) - 1) // 80), lambda k: substr(b[2], k * 80 + 1, 80) || chr(10))), 'string_agg', ''),
    substr(b[2], (length(b[2]) - 1) // 80 * 80 + 1)] END) END AS w FROM t),
r AS (SELECT doc_id, text, pos, w IS NOT NULL AS wide, CASE WHEN w IS NULL THEN line WHEN w[2] <> '' THEN w[1] || rtrim(w[2], ' ') ELSE left(w[1], length(w[1]) - 1) END AS rows FROM f)"""


@query(WRAPPED + """
SELECT doc_id, bool_or(wide) AS is_wrapped, len(string_split(string_agg(rows, chr(10) ORDER BY pos), chr(10)))::INTEGER AS lines, md5(string_agg(rows, chr(10) ORDER BY pos)) AS text_md5 FROM r GROUP BY doc_id""")
def wrap_text(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", text.wrap_text(F.col("text"), 80).alias("w"))
    return d.select("doc_id", "w.is_wrapped", F.size(F.split("w.text", "\n")).alias("lines"), F.md5("w.text").alias("text_md5"))


@query(WRAPPED + """,
o AS (SELECT doc_id, any_value(text) AS text, min(pos) FILTER (wide) AS first FROM r GROUP BY doc_id),
b AS (SELECT r.doc_id, any_value(o.text) AS text, any_value(o.first) AS first, coalesce(string_agg(rows, '' ORDER BY pos) FILTER (pos < o.first), '') AS before,
  any_value(rows) FILTER (pos = o.first) AS broken, string_agg(rows, chr(10) ORDER BY pos) AS plain FROM r JOIN o ON r.doc_id = o.doc_id GROUP BY r.doc_id),
x AS (SELECT *, split_part(broken, chr(10), 1) || chr(10) || replace(substr(broken, strpos(broken, chr(10)) + 1), chr(10), ' ') AS once FROM b)
SELECT doc_id, first IS NOT NULL AS is_wrapped, md5(CASE WHEN first IS NULL THEN plain ELSE before || once || regexp_replace(substr(text, length(once) + 1), '\\s+$', '') END) AS text_md5 FROM x""")
def wrap_text_once(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", text.wrap_text(F.col("text"), 80, once=True).alias("w"))
    return d.select("doc_id", "w.is_wrapped", F.md5("w.text").alias("text_md5"))


# Lookups

WORDS = "SELECT word AS key, p_brand AS value, p_partkey * 100 + i AS seq FROM (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)"
DICT = f"SELECT lower(key) AS key, arg_max(value, seq) AS value FROM ({WORDS}) WHERE regexp_full_match(lower(key), '[a-z]*') GROUP BY 1"


def _words(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.posexplode(F.split("p_name", " ")).alias("i", "key"), F.col("p_brand").alias("value"), "p_partkey").selectExpr("key", "value", "p_partkey * 100 + i AS seq")


@query(f"SELECT c_custkey, coalesce(d.value, 'none') AS value FROM (SELECT c_custkey, lower(c_mktsegment) AS k FROM customer UNION ALL SELECT p_partkey, lower(split_part(p_name, ' ', 1)) FROM part) q LEFT JOIN ({DICT}) d ON q.k = d.key")
def exact_lookup(spark, sf_dir):
    q = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment AS key").union(_table(spark, sf_dir, "part").selectExpr("p_partkey", "split(p_name, ' ')[0]"))
    return lookups.exact_lookup(q, _words(spark, sf_dir), F.lit("none")).select("c_custkey", "value")


@query(f"""
WITH d AS ({DICT}), q AS (SELECT p_partkey AS query_id, lower(substr(p_name, 1, p_partkey % 4)) AS prefix FROM part)
SELECT query_id, rank, key, value FROM q JOIN (SELECT prefix, key, value, row_number() OVER (PARTITION BY prefix ORDER BY length(key), key) AS rank FROM (SELECT DISTINCT prefix FROM q) p JOIN d ON starts_with(d.key, p.prefix)) r USING (prefix) WHERE rank <= 5""")
def prefix_lookup(spark, sf_dir):
    q = _table(spark, sf_dir, "part").selectExpr("p_partkey AS query_id", "substring(p_name, 1, int(p_partkey % 4)) AS prefix")
    return lookups.prefix_lookup(q, _words(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT o_orderkey, coalesce(idx, -1) AS idx FROM (SELECT o_orderkey, o_custkey % 25 AS list_id, 'Customer#' || lpad((o_orderkey % 500)::VARCHAR, 9, '0') AS probe FROM orders) q LEFT JOIN (SELECT c_nationkey AS list_id, c_name AS probe, min(c_custkey) AS idx FROM customer GROUP BY 1, 2) i USING (list_id, probe)")
def find_first(spark, sf_dir):
    q = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 25 AS list_id", "concat('Customer#', lpad(o_orderkey % 500, 9, '0')) AS probe")
    i = _table(spark, sf_dir, "customer").selectExpr("bigint(c_nationkey) AS list_id", "c_custkey AS idx", "c_name AS text")
    return lookups.find_first(q, i).select("o_orderkey", "idx")


MATCHED = """SELECT q.query_id, coalesce(min(i.idx), -1) AS idx FROM (SELECT p_partkey AS query_id, p_size % 25 AS list_id, {probe} AS probe FROM part) q
LEFT JOIN (SELECT c_nationkey AS list_id, c_custkey AS idx, c_name AS text, c_mktsegment AS data FROM customer) i ON q.list_id = i.list_id AND {on} GROUP BY q.query_id"""


def _matched(spark, sf_dir, probe: str, by: str, match: str) -> DataFrame:
    q = _table(spark, sf_dir, "part").selectExpr("p_partkey AS query_id", "p_size % 25 AS list_id", f"{probe} AS probe")
    i = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS list_id", "c_custkey AS idx", "c_name AS text", "c_mktsegment AS data")
    return lookups.find_first(q, i, by, match).select("query_id", "idx")


@query(MATCHED.format(probe="CASE WHEN p_partkey % 2 = 0 THEN 'building' ELSE p_brand END", on="lower(i.data) = lower(q.probe)"))
def find_first_data(spark, sf_dir):
    return _matched(spark, sf_dir, "CASE WHEN p_partkey % 2 = 0 THEN 'building' ELSE p_brand END", "data", "fixed")


@query(MATCHED.format(probe="substr((p_partkey % 1000)::VARCHAR, 1, 2)", on="ends_with(i.text, q.probe)"))
def find_first_end(spark, sf_dir):
    return _matched(spark, sf_dir, "substr(string(p_partkey % 1000), 1, 2)", "text", "ends")


@query(MATCHED.format(probe="substr(p_partkey::VARCHAR, 1, 3)", on="contains(i.text, q.probe)"))
def find_first_inside(spark, sf_dir):
    return _matched(spark, sf_dir, "substr(string(p_partkey), 1, 3)", "text", "contains")


@query("""
WITH a AS (SELECT s_name AS name, s_nationkey AS grp, unnest([upper(s_name), 'NATION ' || s_nationkey, n_name]) AS alias, unnest([0, 1, 2]) AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v AS (SELECT n_name AS real_name, n_nationkey * 2 AS pos FROM nation UNION ALL SELECT lower(n_name), n_nationkey * 2 + (n_nationkey % 2) * 2 - 1 FROM nation UNION ALL SELECT 'Nation ' || n_nationkey, 1000 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0),
r AS (SELECT lower(real_name) AS low, arg_min(real_name, pos) AS real_name FROM v GROUP BY 1)
SELECT name, grp, arg_min(real_name, pos) AS real_name FROM a JOIN r ON lower(alias) = low GROUP BY name, grp""")
def resolve_alias(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    s = _table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    a = s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("grp"), F.array(F.upper("s_name"), F.concat(F.lit("NATION "), "s_nationkey"), "n_name").alias("aliases"))
    real = n.selectExpr("n_name AS real_name", "n_nationkey * 2 AS pos").union(n.selectExpr("lower(n_name)", "n_nationkey * 2 + (n_nationkey % 2) * 2 - 1"))
    real = real.union(n.where("n_nationkey % 2 = 0").selectExpr("concat('Nation ', n_nationkey)", "1000 + n_nationkey"))
    return lookups.resolve_alias(a, real)


@query("SELECT c_custkey, coalesce(CASE WHEN n_regionkey = 1 THEN 'B ' || n_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'A ' || n_name END, n_name) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def localize(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    cat = lambda mark, cond: n.where(cond).select(F.col("n_regionkey").alias("context"), F.col("n_name").alias("source"), F.concat(F.lit(mark), "n_name").alias("translation"))
    d = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("context"), F.col("n_name").alias("source"))
    return lookups.localize(d, cat("A ", "n_nationkey % 2 = 0"), cat("B ", "n_regionkey = 1")).select("c_custkey", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE 'de ' || n_name END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def localize_to(spark, sf_dir):
    """One catalogue of two locales; German lacks the texts of every third customer."""
    d = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.select("c_custkey", (F.col("c_custkey") % 3).alias("context"), F.col("n_name").alias("source"))
    every = d.select("context", "source").distinct()
    of = lambda locale: every.select(F.lit(locale).alias("locale"), "context", "source", F.concat(F.lit(f"{locale} "), "source").alias("translation"))
    return lookups.localize(d, of("de").where("context <> 0").union(of("fr")), locale="de").select("c_custkey", "text")


@query("""
WITH c AS (SELECT n_name AS context, c_name || ' & <' || c_mktsegment || '>' AS source, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'de' AS locale, context, source, CASE WHEN c_custkey % 4 <> 0 THEN 'de: ' || source END AS translation FROM c UNION ALL SELECT 'zh_CN', context, source, '客户 ' || c_custkey FROM c""")
def read_translations(spark, sf_dir):
    """Two catalogues of all customers, written as XML by Spark and read back; every fourth text has no German translation."""
    n = _table(spark, sf_dir, "nation")
    c = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_name").alias("context"), F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit(">")).alias("source"), "c_custkey")
    folder = new_path(spark)
    files.write_translations(c.withColumn("translation", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("de: "), "source"))), f"{folder}/app.de.ts")
    files.write_translations(c.withColumn("translation", F.concat(F.lit("客户 "), "c_custkey")), f"{folder}/app.zh_CN.ts")
    return files.read_translations(spark, f"{folder}/*.ts")


_SCHEMA = "key string, kind string, min double, max double, options array<string>, default string, restart boolean"


def _settings_schema(spark):
    rows = [("k", "range", 10.0, 60.0, None, "30", False), ("mode", "option", None, None, ["on", "off", "auto"], "auto", True), ("flag", "bool", None, None, None, "false", False),
            ("ratio", "range", 2.5, 9.0, None, "4.5", False), ("color", "color", None, None, None, "#102030", False)]
    return spark.createDataFrame(rows, _SCHEMA)


def _settings(spark, sf_dir):
    return files.read_settings(_table(spark, sf_dir, "events").select(F.col("event_id").alias("entity_id"), F.col("props").alias("json")))


@query("""
SELECT event_id AS entity_id, unnest(['k', 'note', 'grp.name', 'grp.n']) AS key, unnest([props->>'k', '{' || event_type || '}', '{"' || event_type || '":1}', user_id::VARCHAR]) AS value FROM events""")
def read_settings(spark, sf_dir):
    """Documents with a group, and with texts that look like one."""
    name = F.to_json(F.create_map(F.lit("name"), F.concat(F.lit('{"'), "event_type", F.lit('":1}'))))
    inner = F.concat(F.expr("substring(name, 1, char_length(name) - 1)"), F.lit(',"n":'), F.col("user_id").cast("string"), F.lit("}"))
    body = F.concat(F.expr("substring(props, 1, char_length(props) - 1)"), F.lit(',"note":"{'), "event_type", F.lit('}","grp":'), "inner", F.lit("}"))
    return files.read_settings(_table(spark, sf_dir, "events").withColumn("name", name).withColumn("inner", inner).select(F.col("event_id").alias("entity_id"), body.alias("json")))


@query("""
WITH e AS (SELECT event_id AS entity_id, (props->>'k')::INTEGER AS k, event_type, value FROM events)
SELECT entity_id, 'k' AS key, greatest(10, least(60, k))::VARCHAR AS value FROM e
UNION ALL SELECT entity_id, 'mode', CASE event_type WHEN 'view' THEN 'off' WHEN 'click' THEN 'auto' ELSE 'on' END FROM e
UNION ALL SELECT entity_id, 'flag', CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END FROM e
UNION ALL SELECT entity_id, 'ratio', CASE WHEN k % 4 = 0 THEN '2.5' WHEN k % 4 = 1 THEN '4.5' WHEN k % 4 = 2 THEN '6.5' ELSE '9' END FROM e
UNION ALL SELECT entity_id, 'color', CASE WHEN k % 2 = 0 THEN '#102030' ELSE '#00FF00' END FROM e""")
def overlay_settings(spark, sf_dir):
    """Known keys with good, bad and missing values, and one key that the schema has not."""
    e = _table(spark, sf_dir, "events").selectExpr("event_id AS entity_id", "int(get_json_object(props, '$.k')) AS k", "event_type")
    values = e.select("entity_id", F.explode(F.create_map(
        F.lit("k"), F.col("k").cast("string"), F.lit("mode"), F.when(F.col("event_type") == "view", "off").when(F.col("event_type") == "click", None).otherwise("loud"),
        F.lit("flag"), F.when(F.col("event_type") == "error", "maybe").otherwise("false"), F.lit("unknown"), F.lit("1"),
        F.lit("ratio"), F.element_at(F.array(F.lit("1.25"), F.lit("x"), F.lit("6.5"), F.lit("11.5")), F.col("k") % 4 + 1),
        F.lit("color"), F.when(F.col("k") % 2 == 0, "blue").otherwise("#00FF00"))).alias("key", "value"))
    return settings.overlay_settings(values, _settings_schema(spark))


@query("SELECT event_id AS entity_id, 'k' AS key, props->>'k' AS old_value, greatest(10, least(60, (props->>'k')::INTEGER))::VARCHAR AS new_value, true AS restart FROM events WHERE (props->>'k')::INTEGER NOT BETWEEN 10 AND 60")
def changed_settings(spark, sf_dir):
    old, schema = _settings(spark, sf_dir), _settings_schema(spark).where("key = 'k'").withColumn("restart", F.lit(True))
    return settings.changed_settings(old, settings.overlay_settings(old, schema), schema)


@query("""SELECT event_id AS entity_id, '{"a":{"x":"' || event_type || '","y":"' || user_id || '"},"k":"' || (props->>'k') || '"}' AS json FROM events""")
def write_settings(spark, sf_dir):
    """A group of two and a key at the top, in the order of their names."""
    e = _table(spark, sf_dir, "events")
    grouped = e.select(F.col("event_id").alias("entity_id"), F.explode(F.create_map(F.lit("a.y"), F.col("user_id").cast("string"), F.lit("a.x"), F.col("event_type"))).alias("key", "value"))
    return files.write_settings(_settings(spark, sf_dir).union(grouped))


@query("SELECT p_partkey, lower('#' || CASE WHEN p_partkey % 2 = 0 THEN 'ff' || substr(md5(p_name), 1, 6) ELSE substr(md5(p_name), 1, 8) END) AS stored FROM part")
def serialize_colors(spark, sf_dir):
    c = F.upper(F.concat(F.lit("#"), F.expr("substring(md5(p_name), 1, 6 + int(p_partkey % 2) * 2)")))
    return _table(spark, sf_dir, "part").select("p_partkey", settings.serialize(settings.deserialize(c, F.lit("color")), F.lit("color")).alias("stored"))


@query("SELECT doc_id, replace(source || '\\docs', '\\', '/') AS path FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0)")
def existing_folders(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    there = d.groupBy("source").count().where("count % 2 = 0").select(F.concat("source", F.lit("/docs")).alias("path"))
    return lookups.existing_folders(d.select("doc_id", F.concat("source", F.lit("\\docs")).alias("path")), there).select("doc_id", "path")


@query("""
WITH a AS (SELECT c_nationkey AS list_id, c_mktsegment AS path, count(*) AS n FROM customer GROUP BY 1, 2), b AS (SELECT c_nationkey AS list_id, c_mktsegment AS path, count(*) AS n FROM customer WHERE c_custkey % 50 <> 7 GROUP BY 1, 2)
SELECT list_id, bool_or(a.n IS DISTINCT FROM b.n) AS changed FROM a FULL JOIN b USING (list_id, path) GROUP BY list_id""")
def folders_changed(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("list_id"), F.col("c_mktsegment").alias("path"), "c_custkey")
    return lookups.folders_changed(a, a.where("c_custkey % 50 <> 7"))


@query("""
WITH a AS (SELECT c_nationkey AS list_id, c_mktsegment AS path FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT DISTINCT c_nationkey AS list_id, c_name AS path FROM customer WHERE c_custkey % 5 = 0 UNION SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT * FROM a UNION ALL SELECT * FROM n WHERE (list_id, path) NOT IN (SELECT list_id, path FROM a)""")
def add_folders(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    of = lambda path, cond: c.where(cond).select(F.col("c_nationkey").alias("list_id"), F.col(path).alias("path"))
    return lookups.add_folders(of("c_mktsegment", "c_custkey % 3 = 0"), of("c_name", "c_custkey % 5 = 0").union(of("c_mktsegment", "true")))


@query("""
WITH RECURSIVE e AS (SELECT NULL AS parent, 'r' || r_regionkey AS child, r_regionkey AS pos, r_regionkey = 0 AS hidden FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 100 - n_nationkey, n_nationkey % 5 = 2 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey, s_suppkey % 7 = 0 FROM supplier),
t AS (SELECT child AS node, 0 AS depth, [pos] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.depth + 1, list_append(t.path, e.pos) FROM t JOIN e ON e.parent = t.node WHERE NOT e.hidden)
SELECT node, depth, array_to_string(path, '.') AS place FROM t""")
def visible_nodes(spark, sf_dir):
    r = _table(spark, sf_dir, "region").selectExpr("string(null) AS parent", "concat('r', r_regionkey) AS child", "bigint(r_regionkey) AS pos", "r_regionkey = 0 AS hidden")
    n = _table(spark, sf_dir, "nation").selectExpr("concat('r', n_regionkey)", "concat('n', n_nationkey)", "bigint(100 - n_nationkey)", "n_nationkey % 5 = 2")
    s = _table(spark, sf_dir, "supplier").selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)", "s_suppkey", "s_suppkey % 7 = 0")
    return lookups.visible_nodes(r.union(n).union(s)).select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("place"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 3 = 1 THEN 'video' ELSE 'other' END AS kind FROM pages")
def media_kind(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a.PNG").when(F.col("page_id") % 3 == 1, "/b.mkv").otherwise("/c.txt"))
    return _table(spark, sf_dir, "pages").select("page_id", files.media_kind(path).alias("kind"))


# Images, derived from the embeddings: 64 values make an 8 x 8 gray image, three of them a colour image

def _images(spark, sf_dir, channels: int = 3) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _as_images(e, channels)


def _as_images(e: DataFrame, channels: int) -> DataFrame:
    value = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.least((x * 100 + 128).cast("int"), F.lit(255)), F.lit(0))), 2, "0"))
    per_pixel = F.transform(value, lambda v, i: F.concat(v, *[F.lpad(F.hex((i * 29 + k * 53) % 256), 2, "0") for k in range(1, channels)]) if channels > 1 else v)
    return e.select(F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(channels).alias("channels"), F.unhex(F.array_join(per_pixel, "")).alias("data"))


def _seen(df: DataFrame) -> DataFrame:
    return df.select("image_id", "width", "height", "channels", F.md5("data").alias("data_md5"), "error")


def _large(spark, sf_dir, w: int, h: int, spread: bool = False) -> DataFrame:
    """Colour images of any size: the 64 values go over the pixels in an order of their own. Vectors that grow much are ``spread`` over the cluster before."""
    hexed = lambda x: F.lpad(F.hex(x), 2, "0")
    value = F.transform("embedding", lambda x: hexed(F.greatest(F.least((x * 100 + 128).cast("int"), F.lit(255)), F.lit(0))))
    # Of which value a pixel's first channel is, and the other two, are the same for all images, and so constants.
    listed = lambda part: F.split(F.lit(" ".join(map(part, range(w * h)))), " ")
    at = listed(lambda i: str((i // w * 5 + i % w * 3) % 64 + 1)).cast("array<int>")
    rest = listed(lambda i: f"{(i * 29 + 53) % 256:02X}{(i * 29 + 106) % 256:02X}")
    data = F.zip_with(at, rest, lambda k, r: F.concat(F.element_at("value", k), r))
    e = _table(spark, sf_dir, "embeddings").select("vec_id", value.alias("value"))
    e = e.repartition(spark.sparkContext.defaultParallelism, "vec_id") if spread else e
    return e.select(F.col("vec_id").cast("string").alias("image_id"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(3).alias("channels"), F.unhex(F.array_join(data, "")).alias("data"))


def _large_sql(w: int, h: int) -> str:
    return f"""SELECT vec_id::VARCHAR AS image_id, i // {w} AS y, i % {w} AS x, c,
  (CASE WHEN c = 0 THEN greatest(least(trunc(embedding[(i // {w} * 5 + i % {w} * 3) % 64 + 1]::DOUBLE * 100 + 128)::INTEGER, 255), 0) ELSE (i * 29 + c * 53) % 256 END)::DOUBLE AS v FROM embeddings, range({w * h}) a(i), range(3) b(c)"""


# One row for each value of an image: y, x, channel c.
PIXELS = """SELECT vec_id::VARCHAR AS image_id, i // 8 AS y, i % 8 AS x, c,
  (CASE WHEN c = 0 THEN greatest(least(trunc(embedding[i + 1]::DOUBLE * 100 + 128)::INTEGER, 255), 0) ELSE (i * 29 + c * 53) % 256 END)::DOUBLE AS v FROM embeddings, range(64) a(i), range(3) b(c)"""


def _image_sql(values: str, w: int, h: int, extra: str = "", pixels: str = "") -> str:
    """``values`` gives image_id, y, x, c, v; ``extra`` are common table expressions that it uses."""
    return f"""WITH p AS ({pixels or PIXELS}){extra}
SELECT image_id, {w} AS width, {h} AS height, 3 AS channels, md5(unhex(string_agg(printf('%02X', v::INTEGER), '' ORDER BY y, x, c))) AS data_md5, NULL::VARCHAR AS error FROM ({values}) GROUP BY image_id"""


def _weights_sql(name: str, n: int, m: int) -> str:
    """How much each of n pixels adds to each of m: a triangle, as much wider as pixels become fewer."""
    scale = f"greatest({n} / {m}::DOUBLE, 1.0)"
    raw = f"SELECT m, j, greatest(1 - abs(j + 0.5::DOUBLE - (m + 0.5::DOUBLE) * {n} / {m}) / {scale}, 0.0) AS w FROM range({m}) a(m), range({n}) b(j)"
    return f"{name} AS (SELECT m, j, w / sum(w) OVER (PARTITION BY m) AS w FROM ({raw}))"


def _shrunk_sql(w: int, h: int, to_w: int, to_h: int) -> str:
    """Common table expressions of images p that end in ``sized``."""
    return f""", {_weights_sql("ya", h, to_h)}, {_weights_sql("xa", w, to_w)},
down_y AS (SELECT image_id, ya.m AS y, x, c, sum(v * ya.w) AS v FROM p JOIN ya ON p.y = ya.j AND ya.w > 0 GROUP BY ALL),
sized AS (SELECT image_id, y, xa.m AS x, c, greatest(least(round_even(round(sum(v * xa.w), 9), 0), 255), 0) AS v FROM down_y JOIN xa ON down_y.x = xa.j AND xa.w > 0 GROUP BY ALL)"""


def _resized_sql(w: int, h: int) -> str:
    return _image_sql("SELECT * FROM sized", w, h, _shrunk_sql(8, 8, w, h))


# A blur of two pixels: 17 taps, edges mirrored, whole numbers after each axis.
BLURRED = """, k AS (SELECT d, exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) * (d / 2.0::DOUBLE)) AS e FROM range(-8, 9) t(d)), taps AS (SELECT d, e / sum(e) OVER () AS t FROM k),
m AS (SELECT n, d, CASE WHEN n + d < 0 THEN -(n + d) - 1 WHEN n + d > 7 THEN 15 - (n + d) ELSE n + d END AS o, t FROM range(8) a(n), taps),
down AS (SELECT image_id, n AS y, x, c, round_even(round(sum(v * t), 9), 0) AS v FROM p JOIN m ON m.o = p.y GROUP BY ALL),
blurred AS (SELECT image_id, y, n AS x, c, round_even(round(sum(v * t), 9), 0) AS v FROM down JOIN m ON m.o = down.x GROUP BY ALL)"""
MARKED = "SELECT image_id, y, x, c, CASE WHEN y BETWEEN {y0} AND {y1} AND x BETWEEN {x0} AND {x1} THEN trunc(v * (1 - {k}::DOUBLE) + 255 * {k}::DOUBLE) ELSE v END AS v FROM p"


@query(_image_sql("SELECT image_id, y, x, c, greatest(least(trunc(v * 0.85::DOUBLE), 255), 0) AS v FROM blurred", 8, 8, BLURRED))
def gaussian_blur(spark, sf_dir):
    return _seen(images.gaussian_blur(_images(spark, sf_dir), 2, 0.85))


@query(_resized_sql(12, 6))
def resize_image(spark, sf_dir):
    return _seen(images.resize_image(_images(spark, sf_dir), 12, 6))


@query(_image_sql("SELECT * FROM sized", 8, 4, _shrunk_sql(24, 12, 8, 4), _large_sql(24, 12)))
def fit_image(spark, sf_dir):
    """Images of 24 x 12 made to fit into 8 x 20: a third of each side, to which every pixel adds."""
    return _seen(images.resize_image(_large(spark, sf_dir, 24, 12), 8, 20, fit=True))


# A blur of half a pixel after shrinking: five taps.
SHRUNK_BLUR = _shrunk_sql(24, 12, 8, 4) + """, k AS (SELECT d, exp(-0.5::DOUBLE * (d / 0.5::DOUBLE) * (d / 0.5::DOUBLE)) AS e FROM range(-2, 3) t(d)), taps AS (SELECT d, e / sum(e) OVER () AS t FROM k),
m AS (SELECT s, n, CASE WHEN n + d < 0 THEN -(n + d) - 1 WHEN n + d > s - 1 THEN 2 * s - 1 - (n + d) ELSE n + d END AS o, t FROM (VALUES (4), (8)) z(s), range(8) a(n), taps WHERE n < s),
down AS (SELECT image_id, n AS y, x, c, round_even(round(sum(v * t), 9), 0) AS v FROM sized JOIN m ON m.o = sized.y AND m.s = 4 GROUP BY ALL),
blurred AS (SELECT image_id, y, n AS x, c, round_even(round(sum(v * t), 9), 0) AS v FROM down JOIN m ON m.o = down.x AND m.s = 8 GROUP BY ALL)"""


@query(_image_sql("SELECT image_id, y, x, c, greatest(least(trunc(v * 1.5::DOUBLE), 255), 0) AS v FROM blurred", 8, 4, SHRUNK_BLUR, _large_sql(24, 12)))
def blur_shrunk(spark, sf_dir):
    """Images of 24 x 12, shrunk to at most 8 x 20 before they are blurred and brightened."""
    return _seen(images.gaussian_blur(_large(spark, sf_dir, 24, 12), 0.5, 1.5, (8, 20)))


@query(_resized_sql(5, 5))
def cover_crop(spark, sf_dir):
    return _seen(images.cover_crop(_images(spark, sf_dir), 5))


@query(_image_sql("SELECT image_id, y, x, c, trunc(trunc(v * (1 - 10 / 255.0::DOUBLE) + 255 * (10 / 255.0::DOUBLE)) * (1 - 150 / 255.0::DOUBLE) + 242 * (150 / 255.0::DOUBLE)) AS v FROM blurred", 8, 8, BLURRED))
def acrylic_composite(spark, sf_dir):
    return _seen(images.acrylic_composite(_images(spark, sf_dir), radius=2))


@query(_image_sql(MARKED.format(y0=6, y1=7, x0=5, x1=7, k=0.2), 8, 8))
def watermark_overlay(spark, sf_dir):
    import numpy as np

    return _seen(images.watermark_overlay(_images(spark, sf_dir), np.full((2, 3, 3), 255, np.uint8)))


@query(_image_sql(MARKED.format(y0=2, y1=5, x0=3, x1=4, k=0.5), 8, 8))
def watermark_rotated(spark, sf_dir):
    import numpy as np

    return _seen(images.watermark_overlay(_images(spark, sf_dir), np.full((2, 4, 3), 255, np.uint8), anchor=4, opacity=50, rotation=90))


# A mark of 4 x 3 for each of the first nine vectors, with a fourth channel; what an image's row says follows from its vec_id.
MARK_ROWS = f"""WITH p AS ({_large_sql(9, 7)}),
g AS (SELECT *, floor(round(4 * abs(co) + 3 * abs(si), 6) + 0.5)::BIGINT AS bw, floor(round(4 * abs(si) + 3 * abs(co), 6) + 0.5)::BIGINT AS bh FROM (SELECT *, cos(radians(turn)) AS co, sin(radians(turn)) AS si FROM (
  SELECT vec_id, vec_id % 9 AS anchor, (20 + vec_id % 5 * 20) / 100.0::DOUBLE AS k, [0, 90, 30, -45, 180, 77][vec_id % 6 + 1]::DOUBLE AS turn FROM embeddings))),
b AS (SELECT *, floor((9 - bw) * (anchor % 3) / 2.0)::BIGINT AS ox, floor((7 - bh) * (anchor // 3) / 2.0)::BIGINT AS oy FROM g),
f AS (SELECT vec_id, k, oy + i AS y, ox + j AS x, round(co * (j - (bw - 1) / 2.0::DOUBLE) + si * (i - (bh - 1) / 2.0::DOUBLE) + 1.5::DOUBLE, 6) AS u, round(co * (i - (bh - 1) / 2.0::DOUBLE) - si * (j - (bw - 1) / 2.0::DOUBLE) + 1.0::DOUBLE, 6) AS v
  FROM b, range(8) s(i), range(8) t(j) WHERE i < bh AND j < bw),
n AS (SELECT vec_id, k, y, x, (floor(u) + dx)::BIGINT AS mx, (floor(v) + dy)::BIGINT AS my, abs(1 - dx - (u - floor(u))) * abs(1 - dy - (v - floor(v))) AS w FROM f, range(2) s(dy), range(2) t(dx)),
m AS (SELECT vec_id, k, y, x, w * (CASE WHEN c3 % 2 = 0 THEN 255 ELSE 100 END / 255.0::DOUBLE) AS part, c3 FROM (SELECT *, my * 4 + mx AS c3 FROM n WHERE mx BETWEEN 0 AND 3 AND my BETWEEN 0 AND 2)),
o AS (SELECT vec_id, k, y, x, sum(part) AS cover, sum(part * ((c3 * 20 + vec_id % 3 * 5))) AS c0, sum(part * (255 - c3 * 9)) AS c1, sum(part * (c3 * c3)) AS c2 FROM m GROUP BY ALL),
z AS (SELECT p.image_id, p.y, p.x, p.c, CASE WHEN o.k IS NULL THEN p.v ELSE trunc(p.v * (1 - o.cover * o.k) + [o.c0, o.c1, o.c2][p.c + 1] * o.k) END AS v FROM p LEFT JOIN o ON p.image_id = o.vec_id::VARCHAR AND p.y = o.y AND p.x = o.x)
SELECT image_id, 9 AS width, 7 AS height, 3 AS channels, md5(unhex(string_agg(printf('%02X', v::INTEGER), '' ORDER BY y, x, c))) AS data_md5, NULL::VARCHAR AS error FROM z GROUP BY image_id"""


@query(MARK_ROWS)
def watermark_rows(spark, sf_dir):
    """Nine anchors, six angles and five opacities; three marks with a channel of their own for what they cover."""
    i = F.sequence(F.lit(0), F.lit(11))
    hexed = lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")
    n = F.col("mark_id")
    data = F.transform(i, lambda i: F.concat(hexed(i * 20 + n * 5), hexed(255 - i * 9), hexed(i * i), hexed(F.when(i % 2 == 0, 255).otherwise(100))))
    marks = _table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("mark_id")).distinct()
    marks = marks.select("mark_id", F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(4).alias("channels"), F.unhex(F.array_join(data, "")).alias("data"))
    v = F.col("image_id").cast("long")
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in (0, 90, 30, -45, 180, 77)]), (v % 6 + 1).cast("int"))
    rows = _large(spark, sf_dir, 9, 7).withColumns({"mark_id": v % 3, "anchor": v % 9, "opacity": 20 + v % 5 * 20, "zoom": F.lit(100), "rotation": turn})
    return _seen(images.watermark_rows(rows, marks))


@query()
def dominant_color(spark, sf_dir):
    return images.dominant_color(_images(spark, sf_dir))


@query()
def dominant_color_wide(spark, sf_dir):
    """Images of 416 x 8, which are made 400 x 400 before their colours are counted."""
    return images.dominant_color(_large(spark, sf_dir, 416, 8, spread=True))
