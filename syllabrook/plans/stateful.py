"""Keyed state over events: failure windows, sessions and tokens, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.operators import stateful as S
from syllabrook.plans.registry import Registry
from syllabrook.session import shared_folder
from syllabrook.sources.tables import table
from syllabrook.streaming.lockout import failure_stream

registry = Registry()
query = registry.query
DAY = 86_400
POLICY = S.FailurePolicy(limit=3, window=2 * DAY, block=DAY)
_D = f"{DAY}000000::BIGINT"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'signup') AND user_id IS NOT NULL),
s AS (SELECT user_id, 0::BIGINT AS k, 0 AS n, NULL::BIGINT AS inicio, NULL::BIGINT AS ate, 0 AS gravadas, 0 AS bloqueios, 0 AS ignoradas FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, k, CASE WHEN b THEN n WHEN NOT f THEN 0 ELSE m END, CASE WHEN b THEN inicio WHEN NOT f THEN NULL WHEN m = 1 THEN t ELSE inicio END,
  CASE WHEN b THEN ate WHEN f AND m >= 3 THEN t + {_D} END, gravadas + CASE WHEN NOT b AND f THEN 1 ELSE 0 END, bloqueios + CASE WHEN NOT b AND f AND m >= 3 THEN 1 ELSE 0 END, ignoradas + CASE WHEN b THEN 1 ELSE 0 END
  FROM (SELECT s.*, e.t, e.f, e.k AS k2, coalesce(s.ate > e.t, FALSE) AS b, CASE WHEN s.n = 0 OR s.inicio <= e.t - 2 * {_D} THEN 1 ELSE s.n + 1 END AS m FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) x(user_id, k0, n, inicio, ate, gravadas, bloqueios, ignoradas, t, f, k, b, m))
SELECT user_id, gravadas, bloqueios, ignoradas FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def login_lockout(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of each user in windows that begin with the first, blocks and attempts ignored while blocked (K1, K2, K3)."""
    events = table(spark, folder, "events").filter(F.col("event_type").isin("error", "signup"))
    return S.failure_windows(events, "user_id", "ts", F.col("event_type") == "error", "event_id", POLICY)


@query()
def login_lockout_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same by a stream over the table that stops when all is read (K1)."""
    events = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = events.filter(F.col("event_type").isin("error", "signup"))
    out = failure_stream(events, "user_id", "ts", F.col("event_type") == "error", "event_id", POLICY)
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/lote={number}")

    out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{place}/rows").parquet(f"{place}/rows")
    return rows.groupBy(F.col("key").alias("user_id")).agg(*(F.max_by(c, "lote").alias(c) for c in ("gravadas", "bloqueios", "ignoradas")))


@query("""SELECT event_id, aberta, coalesce(ts - aberta <= INTERVAL 8 HOUR, FALSE) AS valida FROM (SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS aberta FROM events) WHERE event_type = 'view'""")
def session_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Views within eight hours of the user's last session opened before (K4, J11, D-2, D-3)."""
    rows = S.last_before(table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "ts", "event_id", F.col("event_type") == "click", "aberta").filter("event_type = 'view'")
    return rows.select("event_id", "aberta", F.coalesce(F.col("ts") - F.col("aberta") <= F.expr("INTERVAL '8' HOUR"), F.lit(False)).alias("valida"))


@query("""SELECT user_id, event_id, ts FROM (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY p.ts, p.event_id) AS n FROM events p JOIN (SELECT user_id, min(ts) AS emitido FROM events WHERE event_type = 'signup' GROUP BY 1) s ON s.user_id = p.user_id WHERE p.event_type = 'purchase' AND p.ts >= s.emitido AND p.ts < s.emitido + INTERVAL 15 DAY) WHERE n = 1""")
def token_consume_once(spark: SparkSession, folder: str) -> DataFrame:
    """The first use of each user's token while it is valid (M9, K5)."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    issued = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("emitido"))
    used = events.filter("event_type = 'purchase'").join(issued, "user_id").filter("ts >= emitido and ts < emitido + INTERVAL 15 DAYS")
    return used.groupBy("user_id").agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("u")).select("user_id", "u.event_id", "u.ts")


@query("""SELECT event_id, user_id, ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY OR user_id % 10 = 3 AS revogada FROM events WHERE event_type = 'click'""")
def revoked_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that are over or whose user had all revoked, at the time of the last event (M10, D-1)."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    now = events.agg(F.max("ts").alias("agora"))  # one row
    rows = events.filter("event_type = 'click'").join(F.broadcast(now))
    return rows.select("event_id", "user_id", ((F.col("ts") < F.col("agora") - F.expr("INTERVAL 10 DAYS")) | (F.col("user_id") % 10 == 3)).alias("revogada"))


@query("""SELECT user_id, date_trunc('day', ts) AS dia, count(*) AS eventos, count(*) FILTER (event_type = 'error') AS falhas FROM events GROUP BY 1, 2""")
def daily_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events and failures of each user by day (A16, D-4)."""
    return table(spark, folder, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("dia")).agg(F.count("*").alias("eventos"), F.count_if(F.col("event_type") == "error").alias("falhas"))


