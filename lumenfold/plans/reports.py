"""Run history, leaderboards, coverage pivots, summaries: reports over small aggregates of large tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import strings
from lumenfold.operators import relational as R
from lumenfold.plans.base import CARDS, FRAMES, RUNS, VIDEOS, cards, frames, registrar, runs, videos
from lumenfold.sources import table

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)

KEY = ["variant", "dataset", "topk"]


@query(f"SELECT variant, dataset, topk, max(seq) AS seq, arg_max(accuracy, run_at) AS accuracy FROM {RUNS} GROUP BY ALL".replace("max(seq) AS seq, ", ""))
def latest_per_key(spark, sf_dir):
    """The newest run of each key; of equal times the later input."""
    return R.last_write(runs(spark, sf_dir), KEY, ["run_at", "seq"]).select(*KEY, "accuracy")


@query(f"SELECT seq, variant, accuracy FROM {RUNS} UNION ALL SELECT seq + 100000000, variant, accuracy FROM {RUNS} WHERE seq % 10 = 0")
def history_append(spark, sf_dir):
    old = runs(spark, sf_dir).select("seq", "variant", "accuracy")
    return old.unionByName(old.where("seq % 10 = 0").withColumn("seq", F.col("seq") + 100000000))


@query(f"SELECT variant, topk, arg_max(accuracy, seq) AS accuracy FROM {RUNS} GROUP BY 1, 2")
def latest_run_wins(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("variant", "topk").agg(F.max_by("accuracy", "seq").alias("accuracy"))


@query(f"SELECT bucket, arg_min(seq, CASE WHEN right_bool THEN 0 ELSE 1000000000 END + seq) AS seq FROM (SELECT seq, CASE WHEN topk = 0 THEN 'top1' WHEN topk = 1 THEN 'top3' ELSE 'top10' END AS bucket, dataset = 1 AS right_bool FROM {RUNS}) GROUP BY 1")
def failure_exemplars(spark, sf_dir):
    """One row a bucket: the first that is preferred, else the first."""
    bucket = F.when(F.col("topk") == 0, "top1").when(F.col("topk") == 1, "top3").otherwise("top10")
    preferred = strings.to_bool(F.when(F.col("dataset") == 1, "Yes").otherwise("no"))
    return runs(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.min_by("seq", F.struct((~preferred).cast("int"), "seq")).alias("seq"))


TOP = f"(SELECT art_id, min(name) AS name, count(DISTINCT card_id) AS n FROM {CARDS} WHERE art_id <> '' GROUP BY 1 ORDER BY n DESC, art_id LIMIT 20)"


def _top(spark, sf_dir):
    arts = cards(spark, sf_dir).where(strings.non_empty(F.col("art_id")).isNotNull()).groupBy("art_id").agg(F.min("name").alias("name"), F.countDistinct("card_id").alias("n"))
    return arts.orderBy(F.desc("n"), "art_id").limit(20)


@query(f"SELECT * FROM {TOP}")
def coverage_top_n(spark, sf_dir):
    return _top(spark, sf_dir)


LAYOUT = ("0", "1", "2", "3", "4")
CELLS = f"(SELECT t.art_id, t.name, CAST(c.number % 5 AS VARCHAR) AS page, count(DISTINCT c.card_id) AS printed, count(f.seq) AS frames FROM {TOP} t JOIN {CARDS} c ON c.art_id = t.art_id LEFT JOIN (SELECT * FROM {FRAMES} WHERE dist <= 10) f ON f.card_id = c.card_id GROUP BY ALL)"


@query(f"SELECT art_id, name, sum(frames)::BIGINT AS total_frames, CAST(count_if(frames > 0) AS BIGINT) AS pages_with_frames, count(*) AS pages_printed, " + ", ".join(f"coalesce(CAST(max(CASE WHEN page = '{p}' THEN frames END) AS VARCHAR), 'N/A') AS \"Page [{p}]\"" for p in LAYOUT) + f" FROM {CELLS} GROUP BY 1, 2")
def coverage_pivot(spark, sf_dir):
    """Frames of each art on each page: N/A where it isn't printed, 0 where it has none; with row totals."""
    printed = _top(spark, sf_dir).select("art_id", "name").join(cards(spark, sf_dir).select("art_id", "card_id", (F.col("number") % 5).cast("string").alias("page")), "art_id")
    counts = frames(spark, sf_dir).where("dist <= 10").join(printed.select("card_id"), "card_id", "left_semi").groupBy("card_id").agg(F.count("*").alias("frames"))
    grid = printed.join(counts, "card_id", "left").groupBy("art_id", "name", "page").agg(F.sum(F.coalesce("frames", F.lit(0))).alias("frames"))
    # one pass over the grid: totals, and a column for each page of the fixed list
    shown = [F.coalesce(F.max(F.when(F.col("page") == p, F.col("frames"))).cast("string"), F.lit("N/A")).alias(f"Page [{p}]") for p in LAYOUT]
    return grid.groupBy("art_id", "name").agg(F.sum("frames").alias("total_frames"), F.count_if(F.col("frames") > 0).alias("pages_with_frames"), F.count("*").alias("pages_printed"), *shown)


@query("SELECT quality, " + ", ".join(f"CAST(count_if(least(doc_id % 7, 2) = {i}) AS BIGINT) AS predicted_{i}" for i in range(3)) + " FROM labels GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    """True class by predicted class, here a rule on the id."""
    pairs = table(spark, sf_dir, "labels").select("quality", F.least(F.col("doc_id") % 7, F.lit(2)).alias("predicted"))
    wide = pairs.groupBy("quality").pivot("predicted", [0, 1, 2]).count()
    return wide.select("quality", *[F.coalesce(str(i), F.lit(0)).alias(f"predicted_{i}") for i in range(3)])


@query("SELECT CASE WHEN quality = 1 THEN 'artwork' ELSE 'edition' END AS criterion, count(*) AS total, CAST(count_if(toxic = 0) AS BIGINT) AS correct, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY 1")
def accuracy_by_criterion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy(F.when(F.col("quality") == 1, "artwork").otherwise("edition").alias("criterion"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 0).alias("correct"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 6).alias("accuracy"))


DETECT = "(SELECT event_id, event_type <> 'error' AS truth, event_id % 5 <> 0 AS found, CASE WHEN event_type <> 'error' AND event_id % 5 <> 0 THEN value END AS cpe, CASE WHEN event_id % 3 <> 0 THEN user_id % 30 END AS dist FROM events)"


@query(f"SELECT round(avg(CASE WHEN truth THEN found::DOUBLE END), 6) AS det_rate, round(avg(CASE WHEN NOT truth THEN found::DOUBLE END), 6) AS fpr, round(avg(cpe), 6) AS cpe, round(avg(dist), 6) AS dist, round(avg(CASE WHEN dist IS NOT NULL THEN (dist <= 10)::DOUBLE END), 6) AS near FROM {DETECT}")
def detector_summary(spark, sf_dir):
    """Means over what is there; null where nothing is."""
    truth, hit = F.col("event_type") != "error", F.col("event_id") % 5 != 0
    rows = table(spark, sf_dir, "events").select(truth.alias("truth"), hit.cast("double").alias("found"), F.when(truth & hit, F.col("value")).alias("cpe"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 30).alias("dist"))
    near = F.when(F.col("dist").isNotNull(), (F.col("dist") <= 10).cast("double"))
    means = {"det_rate": F.when(F.col("truth"), F.col("found")), "fpr": F.when(~F.col("truth"), F.col("found")), "cpe": F.col("cpe"), "dist": F.col("dist"), "near": near}
    return rows.agg(*[F.round(F.avg(c), 6).alias(n) for n, c in means.items()])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    v, rows = F.col("value"), table(spark, sf_dir, "events")
    cuts = R.exact_percentiles(rows, ["event_type"], "value", [0.5, 0.95]).select(F.col("event_type").alias("kind"), "p")
    sums = rows.groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    found = sums.join(cuts, F.col("event_type").eqNullSafe(F.col("kind")), "left")
    return found.select("event_type", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"), "least", "most")


@query(f"SELECT dist, count(*) AS n, CAST(count_if(dist <= 20) AS BIGINT) AS keep FROM {FRAMES} WHERE dist IS NOT NULL GROUP BY 1")
def threshold_histogram(spark, sf_dir):
    return frames(spark, sf_dir).where("dist is not null").groupBy("dist").agg(F.count("*").alias("n"), F.count_if(F.col("dist") <= 20).alias("keep"))


@query(f"SELECT count(*) AS n, CAST(median(dist) AS DOUBLE) AS middle, min(dist) AS least, max(dist) AS most, count(CASE WHEN line = 1 THEN 1 END) AS reviewed FROM {FRAMES} WHERE dist IS NOT NULL")
def review_stats(spark, sf_dir):
    rows = frames(spark, sf_dir).where("dist is not null")
    # bit distances take few values, so that the median is one of a table of counts
    counts = rows.groupBy("dist").agg(F.count("*").alias("c"), F.count_if(F.col("line") == 1).alias("r"))
    return counts.agg(F.sum("c").alias("n"), F.percentile("dist", 0.5, F.col("c")).alias("middle"), F.min("dist").alias("least"), F.max("dist").alias("most"), F.coalesce(F.sum("r"), F.lit(0)).alias("reviewed"))


@query(f"WITH c AS (SELECT f.card_id % 25 AS grp, f.seq, abs(f.dist - 20) AS gap FROM {FRAMES} f WHERE dist <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gap, seq) AS rn FROM c) SELECT grp, seq, gap FROM r ORDER BY CASE WHEN rn > 1 THEN 1 ELSE 0 END, gap, seq LIMIT 40")
def diverse_sample_near_threshold(spark, sf_dir):
    """The frames nearest below a threshold: one of each group first, then the rest."""
    near = frames(spark, sf_dir).where("dist <= 20").select((F.col("card_id") % 25).alias("grp"), "seq", F.abs(F.col("dist") - 20).alias("gap"))
    first = near.groupBy("grp").agg(F.min(F.struct("gap", "seq")).alias("f")).select("grp", F.col("f.seq").alias("first"))
    ranked = near.join(first, "grp").withColumn("later", (F.col("seq") != F.col("first")).cast("int"))
    return ranked.orderBy("later", "gap", "seq").limit(40).select("grp", "seq", "gap")


@query(f"SELECT variant, round(sum(accuracy * (1 + seq % 4)) / sum(1 + seq % 4), 6) AS mean FROM {RUNS} GROUP BY 1")
def weighted_epoch_mean(spark, sf_dir):
    weight = 1 + F.col("seq") % 4
    return runs(spark, sf_dir).groupBy("variant").agg(F.round(F.sum(F.col("accuracy") * weight) / F.sum(weight), 6).alias("mean"))


@query("SELECT lang, count(*) AS n, round(avg(length(text)) * count(*), 3) AS total FROM documents GROUP BY 1")
def size_extrapolation(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")) * F.count("*"), 3).alias("total"))


@query(f"WITH m AS (SELECT card_id % 50 AS grp, median(matches) AS canonical FROM {FRAMES} GROUP BY 1) SELECT f.video_id, round(avg(f.matches - m.canonical), 6) AS residual FROM {FRAMES} f JOIN m ON m.grp = f.card_id % 50 GROUP BY 1")
def canonical_median_residual(spark, sf_dir):
    """Median of each group, and each copy's mean difference from it."""
    rows = frames(spark, sf_dir).select("video_id", (F.col("card_id") % 50).alias("grp"), "matches")
    counts = rows.where("matches is not null").groupBy("grp", "matches").agg(F.count("*").alias("c"))
    middle = counts.groupBy("grp").agg(F.percentile("matches", 0.5, F.col("c")).alias("canonical"))
    return rows.join(middle, "grp").groupBy("video_id").agg(F.round(F.avg(F.col("matches") - F.col("canonical")), 6).alias("residual"))


@query(f"WITH r AS (SELECT video_id, row_number() OVER (ORDER BY sha256('3:' || CAST(video_id AS VARCHAR))) AS rn, count(*) OVER () AS n FROM {VIDEOS}) SELECT video_id FROM r WHERE rn <= n * 0.1")
def head_fraction_split(spark, sf_dir):
    """The first tenth in a reproducible shuffle.

    Hashes are counted by their first four digits, of which there are 65,536; only those of the one group in which the
    tenth ends are sorted.
    """
    from lumenfold.functions.hashing import order_key

    rows = videos(spark, sf_dir).select("video_id", order_key(F.col("video_id"), "3").alias("h")).withColumn("head", F.substring("h", 1, 4))
    groups = sorted((r["head"], r["count"]) for r in rows.groupBy("head").count().collect())
    wanted, edge = int(sum(n for _, n in groups) * 0.1), None
    for head, n in groups:
        if n > wanted:
            edge = head
            break
        wanted -= n
    whole = rows.where(F.col("head") < edge) if edge else rows
    rest = rows.where(F.col("head") == edge).orderBy("h").limit(wanted) if edge else rows.limit(0)
    return whole.unionByName(rest).select("video_id")


@query(f"SELECT video_id FROM {VIDEOS} ORDER BY sha256('42:' || CAST(video_id AS VARCHAR)) LIMIT 100")
def seeded_subsample(spark, sf_dir):
    from lumenfold.functions.hashing import order_key

    return videos(spark, sf_dir).select("video_id").orderBy(order_key(F.col("video_id"), "42")).limit(100)


@query(f"SELECT variant, arg_max(seq, run_at) AS newest, max(run_at) = max(run_at) AS ok FROM {RUNS} GROUP BY 1".replace(", max(run_at) = max(run_at) AS ok", ""))
def newest_checkpoint(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("variant").agg(F.max_by("seq", F.struct("run_at", "seq")).alias("newest"))


@query(f"SELECT seq, variant FROM {RUNS} WHERE seq % 15 = 0")
def checkpoints_every_n(spark, sf_dir):
    return runs(spark, sf_dir).where("seq % 15 = 0").select("seq", "variant").orderBy("seq", "variant")


@query(f"SELECT dataset, arg_min(variant, CASE WHEN variant = 'click' THEN '0' ELSE '1' END || variant) AS pick FROM {RUNS} GROUP BY 1")
def identifier_precedence(spark, sf_dir):
    """The name that precedence puts first, then the alphabet."""
    return runs(spark, sf_dir).groupBy("dataset").agg(F.min_by("variant", F.struct((F.col("variant") != "click").cast("int"), "variant")).alias("pick"))


@query(f"SELECT variant, dataset, topk, round(max(accuracy), 6) AS best FROM {RUNS} GROUP BY ALL")
def report_order(spark, sf_dir):
    """Report rows in the order in which they are shown; topk as a number."""
    return runs(spark, sf_dir).groupBy(*KEY).agg(F.round(F.max("accuracy"), 6).alias("best")).orderBy("variant", "dataset", "topk")


@query(f"SELECT video_id, line, dist FROM {FRAMES} ORDER BY dist NULLS LAST, seq LIMIT 50")
def limit_n(spark, sf_dir):
    return frames(spark, sf_dir).orderBy(F.asc_nulls_last("dist"), "seq").limit(50).select("video_id", "line", "dist")


@query(f"SELECT card_id, min(seq) AS seq FROM {FRAMES} GROUP BY 1")
def dedupe_keep_first(spark, sf_dir):
    """Distinct in the order of first sight."""
    return R.first_write(frames(spark, sf_dir).select("card_id", "seq"), ["card_id"], ["seq"])


@query(f"SELECT variant, " + ", ".join(f"round(max(CASE WHEN topk = {k} THEN accuracy END), 6) AS k{k}" for k in range(3)) + f" FROM {RUNS} GROUP BY 1")
def summary_pivot(spark, sf_dir):
    wide = runs(spark, sf_dir).groupBy("variant").pivot("topk", [0, 1, 2]).agg(F.max("accuracy"))
    return wide.select("variant", *[F.round(str(k), 6).alias(f"k{k}") for k in range(3)])


@query(f"SELECT seq, variant, accuracy FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY variant ORDER BY accuracy DESC, seq) <= 5")
def worst_n_per_variant(spark, sf_dir):
    return R.topk_per_group(runs(spark, sf_dir), ["variant"], [F.desc("accuracy"), F.col("seq")], 5).select("seq", "variant", "accuracy")


@query(f"SELECT '| ' || variant || ' | ' || CAST(topk AS VARCHAR) || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM {RUNS} GROUP BY variant, topk")
def markdown_rows(spark, sf_dir):
    """Rows of a Markdown table, one string each."""
    counts = runs(spark, sf_dir).groupBy("variant", "topk").count()
    return counts.select(F.format_string("| %s | %d | %d |", strings.md_escape(F.col("variant")), "topk", "count").alias("line"))


@query(f"SELECT a.seq, CASE WHEN a.keep AND b.keep THEN a.accuracy END AS both FROM (SELECT seq, seq % 3 <> 0 AS keep, accuracy FROM {RUNS}) a JOIN (SELECT seq, seq % 4 <> 0 AS keep FROM {RUNS}) b ON a.seq = b.seq")
def pred_truth_pairing(spark, sf_dir):
    """Prediction and truth side by side; no metric where either is absent."""
    rows = runs(spark, sf_dir)
    pred, truth = rows.where("seq % 3 <> 0").select("seq", "accuracy"), rows.where("seq % 4 <> 0").select("seq", F.lit(True).alias("t"))
    return rows.select("seq").join(pred, "seq", "left").join(truth, "seq", "left").select("seq", F.when(F.col("t"), F.col("accuracy")).alias("both"))


@query(f"WITH seen AS (SELECT DISTINCT variant FROM {RUNS} WHERE dataset = 0 AND variant <> 'click'), cached AS (SELECT variant, seq FROM {RUNS} WHERE dataset = 0 AND variant <> 'click') SELECT variant, seq FROM cached UNION ALL SELECT variant, min(seq) FROM {RUNS} WHERE variant NOT IN (SELECT variant FROM seen) GROUP BY 1")
def cached_or_rebuilt(spark, sf_dir):
    """Cached rows of each variant, or rows rebuilt from elsewhere for a variant without any."""
    rows = runs(spark, sf_dir)
    cached = rows.where("dataset = 0 and variant <> 'click'").select("variant", "seq")
    missing = rows.join(cached.select("variant").distinct(), "variant", "left_anti").groupBy("variant").agg(F.min("seq").alias("seq"))
    return cached.unionByName(missing)


@query(f"SELECT video_id, line, lead(matches, 1, 0) OVER (PARTITION BY video_id ORDER BY matches DESC, line) AS second, matches FROM {FRAMES} QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY matches DESC, line) = 1 AND matches >= 20 AND matches - second >= 5")
def match_vote_margin(spark, sf_dir):
    """The best match of a frame if it is good enough and well ahead of the second."""
    w = W.partitionBy("video_id").orderBy(F.desc("matches"), "line")
    ranked = frames(spark, sf_dir).withColumns({"rn": F.row_number().over(w), "second": F.lead("matches", 1, 0).over(w)})
    return ranked.where("rn = 1 and matches >= 20 and matches - second >= 5").select("video_id", "line", "second", "matches")
