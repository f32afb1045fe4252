"""Incremental maintenance, status lifecycles, gates, streams' batch twins and sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import wiki
from lumenfold.operators import relational as R
from lumenfold.operators import sequential
from lumenfold.plans.base import CARDS, FRAMES, VIDEOS, cards, frames, registrar, videos
from lumenfold.sources import files, table
from lumenfold.sources.scratch import scratch
from lumenfold.streaming import scan

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)


@query(f"SELECT video_id, channel FROM {VIDEOS} WHERE video_id NOT IN (SELECT video_id FROM {VIDEOS} WHERE status = 'done')")
def videos_new_anti(spark, sf_dir):
    rows = videos(spark, sf_dir)
    return rows.join(rows.where("status = 'done'").select("video_id"), "video_id", "left_anti").select("video_id", "channel")


@query(f"SELECT seq FROM {FRAMES} WHERE card_id NOT IN (SELECT card_id FROM {FRAMES} WHERE matches >= 49)")
def frames_unmatched_anti(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.join(rows.where("matches >= 49").select("card_id").distinct(), "card_id", "left_anti").select("seq")


@query(f"SELECT video_id FROM {VIDEOS} WHERE status IN ('done', 'pending') AND video_id NOT IN (SELECT video_id FROM {FRAMES} WHERE line >= 6)")
def videos_pending_anti(spark, sf_dir):
    """Videos of some statuses that a pass hasn't logged."""
    log = frames(spark, sf_dir).where("line >= 6").select("video_id").distinct()
    return videos(spark, sf_dir).where(F.col("status").isin("done", "pending")).join(log, "video_id", "left_anti").select("video_id")


@query(f"SELECT video_id, added FROM {VIDEOS} WHERE status = 'pending' ORDER BY video_id DESC LIMIT 10")
def video_claim_order(spark, sf_dir):
    """The next jobs, the newest first."""
    return videos(spark, sf_dir).where("status = 'pending'").orderBy(F.desc("video_id")).limit(10).select("video_id", "added")


@query(f"SELECT video_id, CASE WHEN status = 'pending' AND video_id % 10 = 0 THEN 'pending' WHEN status = 'pending' THEN 'matched' WHEN status = 'error' THEN 'downloaded' ELSE status END AS status FROM {VIDEOS}")
def video_status_transition(spark, sf_dir):
    """One step of the lifecycle: a failed job goes back to where it was."""
    s, failed = F.col("status"), F.col("video_id") % 10 == 0
    after = F.when((s == "pending") & failed, "pending").when(s == "pending", "matched").when(s == "error", "downloaded").otherwise(s)
    return videos(spark, sf_dir).select("video_id", after.alias("status"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 10 THEN 'skip' WHEN user_id % 4 = 0 AND value > 50 THEN 'pending' ELSE 'needs_review' END AS status FROM events")
def annotate_decision_table(spark, sf_dir):
    v = F.col("value")
    status = F.when(F.col("event_type") == "error", "error").when(v < 10, "skip").when((F.col("user_id") % 4 == 0) & (v > 50), "pending").otherwise("needs_review")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("SELECT o_orderkey AS id, array_to_string(list_sort(list_filter(codes, lambda x: x IN (SELECT lower(replace(p_brand, 'Brand#', 'b')) FROM part))), ',') AS good FROM (SELECT o_orderkey, ['b' || CAST(o_orderkey % 40 AS VARCHAR), 'b' || CAST(o_custkey % 40 AS VARCHAR) || 'x'] AS codes FROM orders)".replace("list_filter(codes, lambda x: x IN (SELECT lower(replace(p_brand, 'Brand#', 'b')) FROM part))", "list_intersect(codes, (SELECT list(DISTINCT lower(replace(p_brand, 'Brand#', 'b'))) FROM part))"))
def set_code_validation(spark, sf_dir):
    """Codes that the catalog knows, as sorted text; a join, as the catalog may be of any size."""
    codes = F.array(F.concat(F.lit("b"), (F.col("o_orderkey") % 40).cast("string")), F.concat(F.lit("b"), (F.col("o_custkey") % 40).cast("string"), F.lit("x")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), codes.alias("codes"))
    known = cards(spark, sf_dir).select(F.col("set_code").alias("code")).distinct().withColumn("known", F.lit(True))
    each = rows.select("id", F.explode("codes").alias("code")).join(known, "code", "left")
    return each.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("known"), F.col("code")))), ",").alias("good"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'no_card' WHEN value < 20 THEN 'low_confidence' WHEN value % 10 < 3 THEN 'blurred' END AS skip_reason FROM events")
def skip_reason_gates(spark, sf_dir):
    """Gates in order, each with its reason; a gate at 0 is off."""
    least, sharp, extra = 20, 3, 0
    v = F.col("value")
    reason = F.when(F.col("event_type") == "error", "no_card")
    for limit, c, name in ((least, v, "low_confidence"), (sharp, v % 10, "blurred"), (extra, v, "never")):
        reason = reason.when(c < limit, name) if limit else reason
    return table(spark, sf_dir, "events").select("event_id", reason.alias("skip_reason"))


OLD, NEW = "(SELECT card_id, art_id AS stamp FROM cards_ WHERE card_id % 5 <> 0)", "(SELECT card_id, CASE WHEN card_id % 7 = 0 THEN 'changed' ELSE art_id END AS stamp FROM cards_ WHERE card_id % 6 <> 0)"


def _caches(spark, sf_dir):
    rows = cards(spark, sf_dir)
    cache = rows.where("card_id % 5 <> 0").select("card_id", F.col("art_id").alias("stamp"), F.col("price").alias("vector"))
    manifest = rows.where("card_id % 6 <> 0").select("card_id", F.when(F.col("card_id") % 7 == 0, "changed").otherwise(F.col("art_id")).alias("stamp"))
    return manifest, cache


@query(f"WITH cards_ AS {CARDS} SELECT CAST(count_if(m.stamp = c.stamp) AS BIGINT) AS reused, CAST(count_if(m.stamp IS NOT NULL AND (c.stamp IS NULL OR c.stamp <> m.stamp)) AS BIGINT) AS added, CAST(count_if(m.stamp IS NULL) AS BIGINT) AS removed FROM {NEW} m FULL JOIN {OLD} c ON m.card_id = c.card_id")
def cache_diff(spark, sf_dir):
    """What an incremental build keeps, computes and drops."""
    return R.cache_diff(*_caches(spark, sf_dir), "card_id", "stamp")


@query(f"WITH cards_ AS {CARDS} SELECT m.card_id, coalesce(CASE WHEN c.stamp = m.stamp THEN k.price END, -1.0) AS vector FROM {NEW} m LEFT JOIN {OLD} c ON m.card_id = c.card_id LEFT JOIN cards_ k ON k.card_id = c.card_id")
def cache_merge(spark, sf_dir):
    """Cached vectors where the stamp is the same, computed ones elsewhere."""
    manifest, cache = _caches(spark, sf_dir)
    return manifest.join(cache, ["card_id", "stamp"], "left").select("card_id", F.coalesce("vector", F.lit(-1.0)).alias("vector"))


@query("SELECT channel, n, video_id, CAST(CASE WHEN n = 0 THEN 0 ELSE sum(secs) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END + n * 2 AS BIGINT) AS starts FROM (SELECT o_orderpriority AS channel, o_orderkey AS video_id, o_orderkey % 50 + 10 AS secs, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders)")
def chapters_running_offset(spark, sf_dir):
    """Where each chapter begins: the lengths before it and the gaps between."""
    rows = videos(spark, sf_dir).select("channel", "video_id", (F.col("video_id") % 50 + 10).alias("secs"))
    found = R.running_before(rows, "channel", "video_id", "secs")
    return found.select("channel", "n", "video_id", (F.col("before") + F.col("n") * 2).alias("starts"))


@query(f"SELECT DISTINCT video_id, card_id FROM {FRAMES}")
def frames_dedupe(spark, sf_dir):
    """An append that a repeat doesn't double: one row for each pair of keys."""
    rows = frames(spark, sf_dir).select("video_id", "card_id")
    return rows.unionByName(rows.where("card_id % 2 = 0")).dropDuplicates(["video_id", "card_id"])


@query(f"SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'matched' ELSE status END AS status, channel FROM {VIDEOS}")
def table_update(spark, sf_dir):
    rows = videos(spark, sf_dir).select("video_id", "status", "channel")
    return R.update_by_key(rows, rows.where("video_id % 3 = 0").select("video_id", F.lit("matched").alias("status")), ["video_id"], ["status"])


@query(f"SELECT seq FROM {FRAMES} WHERE video_id % 4 <> 0")
def table_delete(spark, sf_dir):
    gone = videos(spark, sf_dir).where("video_id % 4 = 0").select("video_id")
    return R.delete_by_key(frames(spark, sf_dir), gone, ["video_id"]).select("seq")


@query(f"SELECT video_id, channel, CASE WHEN video_id % 2 = 0 THEN 'first' END AS game FROM {VIDEOS}")
def add_column(spark, sf_dir):
    """Old rows without a column and new rows with it."""
    rows = videos(spark, sf_dir).select("video_id", "channel")
    return rows.where("video_id % 2 <> 0").unionByName(rows.where("video_id % 2 = 0").withColumn("game", F.lit("first")), allowMissingColumns=True)


@query(f"SELECT seq, CASE WHEN seq % 5 = 0 THEN 'ok' END AS review FROM {FRAMES}")
def review_flag(spark, sf_dir):
    rows = frames(spark, sf_dir).select("seq", F.lit(None).cast("string").alias("review"))
    return R.update_by_key(rows, rows.where("seq % 5 = 0").select("seq", F.lit("ok").alias("review")).distinct(), ["seq"], ["review"])


@query(f"SELECT card_id, upper(name) AS name FROM {CARDS} WHERE card_id % 3 <> 1")
def resume_parts(spark, sf_dir):
    """A build that was interrupted after one part goes on: what is done is read, the rest is built, all parts are merged."""
    rows, root, schema = cards(spark, sf_dir).select("card_id", "name"), scratch(spark, "parts"), "card_id bigint, name string"
    build = lambda items: items.select("card_id", F.upper("name").alias("name"))
    files.write_part(build(rows.where("card_id % 3 = 0")), root, 0)
    files.build_rest(rows.where("card_id % 3 <> 1"), root, schema, "card_id", build, part=1)
    files.merge_parts(spark, root, schema, f"{root}-merged")
    return files.read_table(spark, f"{root}-merged")


@query("SELECT event_type, count(*) AS stale FROM events WHERE event_type IN ('error', 'view', 'signup') GROUP BY 1")
def stale_inputs(spark, sf_dir):
    """Events of the types whose output is older than its input, or missing, by the files' times of modification."""
    rows, root = table(spark, sf_dir, "events"), scratch(spark, "fresh")
    counts = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    written = lambda df, name: df.write.mode("append").partitionBy("event_type").parquet(f"{root}/{name}")
    written(counts, "in")
    written(counts.where("event_type <> 'signup'"), "out")
    written(counts.where("event_type in ('error', 'view')"), "in")  # new input after the output
    kind = F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")
    listed = lambda name: files.list_files(spark, f"{root}/{name}", "*.parquet").select(kind, "modified")
    return rows.join(files.stale_outputs(listed("in"), listed("out"), "event_type"), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("stale"))


@query(f"SELECT card_id, price FROM {CARDS} WHERE price > 1000")
def latest_full_reload(spark, sf_dir):
    """A table that was loaded before is replaced as a whole: of what it held, nothing stays."""
    rows, where = cards(spark, sf_dir).select("card_id", "price"), scratch(spark, "prices")
    files.replace_table(rows.select((F.col("card_id") + 1_000_000).alias("card_id"), F.lit(0.0).alias("price")), where)
    files.replace_table(rows.where("price > 1000"), where)
    return files.read_table(spark, where)


@query("""
WITH RECURSIVE e AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS at_us FROM events),
k AS (SELECT user_id, min(at_us) AS at_us FROM e GROUP BY 1 UNION ALL SELECT k.user_id, (SELECT min(e.at_us) FROM e WHERE e.user_id = k.user_id AND e.at_us >= k.at_us + 86400000000) FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = k.user_id AND e.at_us >= k.at_us + 86400000000))
SELECT user_id, at_us FROM k
""")
def frame_sampling_fps(spark, sf_dir):
    """Frames at least a period after the last one kept, here a day of a user's events."""
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros("ts").alias("at_us"))
    return sequential.sample_frames(rows, "user_id", "at_us", 86_400_000_000)


def scans(spark, sf_dir):
    """Events as scans: the session is a fifth of users, an error is no card."""
    card = F.when(F.col("value") > 5, F.col("event_type"))
    rows = table(spark, sf_dir, "events").withColumn("session", F.col("user_id") % 5)
    return scan.scan_events(rows, "session", "ts", "event_id", F.col("event_type") != "error", card)


# one event of every session a round: the candidate, its hits, and when each id was confirmed
@query("""
WITH RECURSIVE e AS (
  SELECT user_id % 5 AS session, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) // 1000, event_id) AS n, epoch_us(ts) // 1000 AS at_ms, event_id AS seq,
         CASE WHEN event_type <> 'error' AND value > 5 THEN event_type END AS hit FROM events),
s AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS candidate, 0 AS hits, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS done, CAST(NULL AS VARCHAR) AS card_id, CAST(0 AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS seq FROM e
  UNION ALL
  SELECT session, n,
         CASE WHEN miss THEN CASE WHEN hits > 1 THEN candidate END WHEN cooling THEN candidate WHEN fires THEN NULL ELSE hit END,
         CASE WHEN miss THEN greatest(hits - 1, 0) WHEN cooling THEN hits WHEN fires THEN 0 WHEN same THEN hits + 1 ELSE 1 END,
         CASE WHEN fires THEN map_concat(done, MAP {hit: at_ms}) ELSE done END,
         CASE WHEN fires THEN hit END, at_ms, seq
    FROM (SELECT *, NOT miss AND NOT cooling AND same AND hits + 1 >= 3 AS fires
            FROM (SELECT s.session, e.n, s.candidate, s.hits, s.done, e.hit, e.at_ms, e.seq, e.hit IS NULL AS miss,
                         coalesce(e.at_ms - s.done[e.hit] < 3600000, false) AS cooling, coalesce(e.hit = s.candidate, false) AS same
                    FROM s JOIN e ON e.session = s.session AND e.n = s.n + 1)))
SELECT session, card_id, at_ms, seq FROM s WHERE card_id IS NOT NULL
""")
def scan_bucket_batch(spark, sf_dir):
    return scan.confirm_batch(scans(spark, sf_dir), scan.Rules(3, 1, 3_600_000))


# Each customer makes up a page in the sources' layout; what a reader of the page gets is stated from the rules of its making.
TICK_PAGE = """{| class="wikitable"
! Set code
! Card
!AAA<br>[[File:a.png]]
!BBB<br>[[File:b.png]]
!C2C<br>c
|-
| %1$s
| some set
| {{card|%1$s||PLIST}}
|%2$s
|%3$s
|{{cell|tick}}
|-
| x
|some set
| {{card|%1$s two|set=x|PLIST}}
| || %2$s
{{cell|tick}}
|-
| a || row || without a card
|{{cell|tick}}
|}"""


@query("""
WITH c AS (SELECT c_custkey, c_name, c_nationkey % 2 = 0 AS even, c_nationkey % 3 = 0 AS third FROM customer)
SELECT c_custkey, 'aaa' AS host_set, c_name AS name FROM c WHERE even
UNION ALL SELECT c_custkey, 'bbb', c_name FROM c WHERE third
UNION ALL SELECT c_custkey, 'c2c', c_name FROM c
UNION ALL SELECT c_custkey, 'bbb', c_name || ' two' FROM c WHERE even
UNION ALL SELECT c_custkey, 'c2c', c_name || ' two' FROM c
""")
def wiki_tick_matrix(spark, sf_dir):
    """Host sets and names of ticked cells."""
    mark = lambda c: F.when(c, "{{cell|tick}}").otherwise("")
    page = F.format_string(TICK_PAGE, "c_name", mark(F.col("c_nationkey") % 2 == 0), mark(F.col("c_nationkey") % 3 == 0))
    found = table(spark, sf_dir, "customer").select("c_custkey", F.explode(wiki.tick_matrix(page)).alias("tick"))
    return found.select("c_custkey", "tick.host_set", "tick.name")


@query("SELECT event_id AS image_key, arg_max(value, seq) AS value FROM (SELECT event_id % 500 AS event_id, event_id AS seq, value FROM events WHERE event_id % 13 <> 0) GROUP BY 1")
def scan_jsonl_last_wins(spark, sf_dir):
    """Lines of JSON, malformed ones skipped, the last of a key kept."""
    rows = table(spark, sf_dir, "events")
    good = F.to_json(F.struct((F.col("event_id") % 500).alias("image_key"), F.col("value")))
    lines = rows.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(good).alias("line"))
    parsed = lines.select("line_no", F.from_json("line", "image_key bigint, value double").alias("j")).where("j.image_key is not null")
    return R.last_write(parsed.select("j.image_key", "j.value", "line_no"), ["image_key"], ["line_no"]).select("image_key", "value")


@query(f"SELECT card_id, art_id AS hex FROM {CARDS}")
def scan_hex_map(spark, sf_dir):
    """A JSON object of ids and hashes, one a partition of cards, exploded."""
    maps = cards(spark, sf_dir).groupBy((F.col("card_id") % 64).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("card_id").cast("string"), "art_id")))).alias("doc"))
    each = maps.select(F.explode(F.from_json("doc", "map<string,string>")).alias("id", "hex"))
    return each.select(F.col("id").cast("bigint").alias("card_id"), "hex")


@query(f"SELECT card_id, name || chr(9) || layout AS title FROM {CARDS}")
def scan_tsv_split(spark, sf_dir):
    """id and title of lines, parted at the first tab only."""
    lines = cards(spark, sf_dir).select(F.concat_ws("\t", F.col("card_id").cast("string"), "name", "layout").alias("value"))
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].cast("bigint").alias("card_id"), parts[1].alias("title"))
