"""Streams over the derived tables, run to their end."""

from __future__ import annotations

from ..sources import tables, views
from ..streaming import limits
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_id AS id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
seen AS (SELECT a.u, a.id, a.ts, count(*) AS n FROM e a JOIN e b ON a.u = b.u AND b.ts > a.ts - INTERVAL 2 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.id <= a.id)) GROUP BY ALL),
over_ AS (SELECT u, min(struct_pack(ts := ts, id := id)) AS first_ FROM seen WHERE n > 3 GROUP BY u),
bans AS (SELECT u, first_ AS b FROM over_ UNION ALL SELECT bans.u, min(struct_pack(ts := s.ts, id := s.id)) FROM bans JOIN seen s ON s.u = bans.u AND s.n > 3 AND s.ts >= bans.b.ts + INTERVAL 1 DAY GROUP BY bans.u)
SELECT s.u AS user, s.id, CASE WHEN o.u IS NOT NULL THEN 'over_limit' WHEN b.u IS NOT NULL THEN 'banned' ELSE 'run' END AS outcome FROM seen s LEFT JOIN bans o ON o.u = s.u AND o.b.id = s.id
LEFT JOIN bans b ON b.u = s.u AND s.ts < b.b.ts + INTERVAL 1 DAY AND (s.ts > b.b.ts OR (s.ts = b.b.ts AND s.id > b.b.id))""")
def requests_with_bans(spark, sf_dir):
    """Each event as a request, in a stream: more than three in two days bring a ban of a day."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(name), tables.shared_folder(spark)
    # A stream's source is a folder of files.
    events = tables.written(views.table(spark, sf_dir, "events").select("user_id", "event_id", "ts"))
    stream = spark.readStream.schema(events.schema).parquet(events.written_to)
    decided = limits.limited(stream, "user_id", "event_id", "ts", most=3, seconds=2 * 86_400, ban_seconds=86_400)
    spark.conf.set(name, limits.PROVIDER)
    try:
        run = decided.where("outcome <> 'released'").select("user", "id", "outcome").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("user string, id bigint, outcome string").parquet(f"{folder}/rows")
