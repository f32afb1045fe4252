"""Search, retrieval evaluation and embedding quality over the embeddings table: class is the label.

Search queries are every row whose id is divisible by 20, against all other rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import vectors
from lumenfold.operators import knn, retrieval
from lumenfold.operators import relational as R
from lumenfold.plans.base import registrar
from lumenfold.sources import table

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)

EMB = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS n FROM embeddings)"
COS = "round(list_inner_product(list_transform(q.v, lambda x: x / q.n), list_transform(g.v, lambda x: x / g.n)), 12)"
HAM = "list_sum(list_transform(list_zip(q.v, g.v), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))"


def hits(metric: str, k: int, queries: str, exclude: str) -> str:
    """SQL for ranked neighbours h(query_id, query_class, id, class, score, rank)."""
    score = COS if metric == "cosine" else f"-CAST({HAM} AS DOUBLE)"
    apart = {"self": "q.id <> g.id", "class": "q.label IS DISTINCT FROM g.label"}[exclude]
    return f"{EMB}, p AS (SELECT q.id AS query_id, q.label AS query_class, g.id AS id, g.label AS class, {score} AS score FROM e q JOIN e g ON {apart} WHERE {queries}), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= {k})"


def gallery(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("class"))


def found(spark, sf_dir, metric="cosine", k=10, every=20, exclude="self"):
    rows = gallery(spark, sf_dir)
    asked = rows.where(f"id % {every} = 0") if every > 1 else rows
    return knn.nearest(asked, rows, k=k, metric=metric, exclude=exclude), asked


SEARCH = "q.id % 20 = 0"
SHOWN = "SELECT query_id, rank, id, round(score, 6) AS score FROM h"


@query(f"WITH {hits('cosine', 10, SEARCH, 'self')} {SHOWN}")
def knn_cosine_top10(spark, sf_dir):
    return found(spark, sf_dir)[0].select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {hits('hamming', 10, SEARCH, 'self')} SELECT query_id, rank, id, CAST(-score AS BIGINT) AS distance FROM h")
def knn_hamming_top10(spark, sf_dir):
    return found(spark, sf_dir, "hamming")[0].select("query_id", "rank", "id", (-F.col("score")).cast("bigint").alias("distance"))


@query(f"WITH {hits('hamming', 1, SEARCH, 'self')} SELECT query_id, id, round(greatest(0.0, 1 + score / 256), 6) AS confidence FROM h")
def knn_best1(spark, sf_dir):
    """The nearest card and the confidence that its distance stands for."""
    best = found(spark, sf_dir, "hamming", k=1)[0]
    return best.select("query_id", "id", F.round(vectors.confidence(-F.col("score"), "hamming"), 6).alias("confidence"))


RANKS = "r AS (SELECT q.id AS query_id, min(CASE WHEN h.class = h.query_class THEN rank END) AS true_rank FROM e q LEFT JOIN h ON h.query_id = q.id WHERE q.id % 20 = 0 GROUP BY 1)"
CUTS = "(SELECT unnest([1, 3, 10]) AS topk)"


@query(f"WITH {hits('cosine', 10, SEARCH, 'self')}, {RANKS} SELECT CAST(topk AS BIGINT) AS topk, CAST(sum(CASE WHEN true_rank <= topk THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, round(avg(CASE WHEN true_rank <= topk THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r, {CUTS} GROUP BY 1")
def recall_at_k(spark, sf_dir):
    near, asked = found(spark, sf_dir)
    ranks = retrieval.truth_ranks(near, asked, F.col("class") == F.col("query_class"))
    return retrieval.recall(ranks, []).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {hits('cosine', 10, SEARCH, 'self')},
r AS (SELECT q.id AS query_id, c.criterion, min(CASE WHEN (criterion = 'label' AND h.class = h.query_class) OR (criterion = 'parity' AND h.class % 2 = h.query_class % 2) THEN rank END) AS true_rank
      FROM e q CROSS JOIN (SELECT unnest(['label', 'parity']) AS criterion) c LEFT JOIN h ON h.query_id = q.id WHERE q.id % 20 = 0 GROUP BY 1, 2)
SELECT criterion, CAST(topk AS BIGINT) AS topk, CAST(sum(CASE WHEN true_rank <= topk THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM r, {CUTS} GROUP BY 1, 2""")
def recall_at_k_multi_criteria(spark, sf_dir):
    """One search, judged by several labels."""
    near, asked = found(spark, sf_dir)
    judged = F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), same.alias("same")) for n, same in (("label", F.col("class") == F.col("query_class")), ("parity", F.col("class") % 2 == F.col("query_class") % 2))])).alias("c")
    ranks = near.select("query_id", "rank", judged).groupBy("query_id", "c.criterion").agg(F.min(F.when(F.col("c.same"), F.col("rank"))).alias("true_rank"))
    return retrieval.recall(ranks, ["criterion"]).drop("accuracy")


@query(f"WITH {hits('cosine', 10, SEARCH, 'self')}, l AS (SELECT query_id, any_value(query_class) AS c, list(class ORDER BY rank) AS top FROM h GROUP BY 1) SELECT CAST(topk AS BIGINT) AS topk, CAST(sum(CASE WHEN list_contains(top[1:topk], c) THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM l, {CUTS} GROUP BY 1")
def recall_from_cached_arrays(spark, sf_dir):
    """Membership of the truth in prefixes of stored result lists."""
    near, _ = found(spark, sf_dir)
    lists = near.groupBy("query_id", "query_class").agg(F.sort_array(F.collect_list(F.struct("rank", "class"))).alias("r")).select("query_class", F.col("r.class").alias("top"))
    each = lists.agg(*[F.count_if(F.array_contains(F.slice("top", 1, k), F.col("query_class"))).alias(f"c{k}") for k in retrieval.CUTS])
    return each.select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("topk"), F.col(f"c{k}").alias("correct")) for k in retrieval.CUTS])).alias("x")).select("x.topk", "x.correct")


@query(f"WITH {EMB}, p AS (SELECT q.id AS query_id, min({HAM}) AS least, min(CASE WHEN q.label = g.label THEN {HAM} END) AS own FROM e q JOIN e g ON q.id <> g.id WHERE {SEARCH} GROUP BY 1) SELECT count(*) AS total, CAST(count_if(own = least) AS BIGINT) AS correct FROM p")
def tie_tolerant_top1(spark, sf_dir):
    """Right if the truth is as near as anything: one nearest of any class against the nearest of another class."""
    rows = gallery(spark, sf_dir)
    asked = rows.where("id % 20 = 0")
    near = knn.nearest(asked, rows, k=1, metric="hamming").select("query_id", F.col("score").alias("best"), F.col("class").alias("c"), "query_class")
    own = knn.nearest(asked, rows, k=1, metric="hamming", exclude="others").select("query_id", F.col("score").alias("own"))
    both = near.join(own, "query_id", "left")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("own") == F.col("best")).alias("correct"))


@query(f"WITH {hits('cosine', 10, SEARCH, 'self')}, {RANKS}, f AS (SELECT h.query_id, h.id AS predicted, round(h.score, 6) AS score, r.true_rank FROM h JOIN r ON r.query_id = h.query_id WHERE h.rank = 1 AND (r.true_rank IS NULL OR r.true_rank > 1)) SELECT query_id, predicted, score, true_rank FROM f ORDER BY score DESC, query_id LIMIT 25")
def retrieval_failures_worst_n(spark, sf_dir):
    """The 25 most confident failures at 1, with the rank of the truth."""
    near, asked = found(spark, sf_dir)
    ranks = retrieval.truth_ranks(near, asked, F.col("class") == F.col("query_class"))
    failed = near.where("rank = 1").join(ranks, "query_id").where("true_rank is null or true_rank > 1")
    return failed.select("query_id", F.col("id").alias("predicted"), F.round("score", 6).alias("score"), "true_rank").orderBy(F.desc("score"), "query_id").limit(25)


ALL = "true"


@query(f"WITH {hits('cosine', 1, ALL, 'self')} SELECT count(*) AS n, CAST(count_if(class = query_class) AS BIGINT) AS same, CAST(count_if(score >= 0.9999 AND class <> query_class) AS BIGINT) AS collisions FROM h")
def nn_purity(spark, sf_dir):
    """Of all rows: nearest neighbours of the same class, and near-equal vectors of another."""
    near, _ = found(spark, sf_dir, k=1, every=1)
    return near.agg(F.count("*").alias("n"), F.count_if(F.col("class") == F.col("query_class")).alias("same"), F.count_if((F.col("score") >= 0.9999) & (F.col("class") != F.col("query_class"))).alias("collisions"))


@query(f"WITH {hits('cosine', 1, ALL, 'class')} SELECT query_id, id, round(score, 6) AS score FROM h")
def nn_diff_nearest(spark, sf_dir):
    """For each row, the nearest of another class."""
    near, _ = found(spark, sf_dir, k=1, every=1, exclude="class")
    return near.select("query_id", "id", F.round("score", 6).alias("score"))


PROFILE = ", ".join(f"CAST(trunc(quantile_cont(-score, {q})) AS BIGINT) AS p{int(q * 100)}" for q in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))


@query(f"WITH {hits('hamming', 1, ALL, 'self')} SELECT {PROFILE} FROM h")
def nn_distance_percentiles(spark, sf_dir):
    near, _ = found(spark, sf_dir, "hamming", k=1, every=1)
    return retrieval.percentile_profile(near.withColumn("distance", -F.col("score")), "distance", True)


@query(f"WITH {hits('hamming', 1, ALL, 'self')}, s AS (SELECT median(-score) AS m FROM h WHERE class = query_class) SELECT count(*) AS others, CAST(count_if(-score >= m) AS BIGINT) AS beyond FROM h, s WHERE class <> query_class")
def nn_overlap_pct(spark, sf_dir):
    """Nearest neighbours of another class at or beyond the median distance of those of the same class."""
    near, _ = found(spark, sf_dir, "hamming", k=1, every=1)
    rows = near.select((-F.col("score")).alias("d"), (F.col("class") == F.col("query_class")).alias("same"))
    middle = rows.where("same").groupBy("d").agg(F.count("*").alias("c")).agg(F.percentile("d", 0.5, F.col("c")).alias("m"))
    others = rows.where("not same").crossJoin(F.broadcast(middle))  # one row
    return others.agg(F.count("*").alias("others"), F.count_if(F.col("d") >= F.col("m")).alias("beyond"))


@query(f"WITH {hits('cosine', 1, ALL, 'class')}, k AS (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS s FROM h GROUP BY 1, 2) SELECT a, b, round(s, 6) AS score FROM k ORDER BY s DESC, a, b LIMIT 20")
def confounder_pairs(spark, sf_dir):
    """The 20 most alike pairs of different classes."""
    near, _ = found(spark, sf_dir, k=1, every=1, exclude="class")
    return retrieval.confounders(near, [F.desc("score"), F.col("a"), F.col("b")], 20).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {hits('cosine', 1, ALL, 'class')}, k AS (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS s FROM h WHERE query_class % 5 <> class % 5 GROUP BY 1, 2) SELECT a, b, round(s, 6) AS score FROM k ORDER BY s DESC, a, b LIMIT 20")
def confounder_pairs_diff_name(spark, sf_dir):
    """The same without pairs that share a name, here the label modulo 5."""
    near, _ = found(spark, sf_dir, k=1, every=1, exclude="class")
    apart = near.where(F.col("query_class") % 5 != F.col("class") % 5)
    return retrieval.confounders(apart, [F.desc("score"), F.col("a"), F.col("b")], 20).select("a", "b", F.round("score", 6).alias("score"))


HEX = "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) WHEN doc_id % 9 = 1 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE md5(CAST(doc_id AS VARCHAR)) END AS h FROM documents)"


@query(f"WITH w AS (SELECT n + n % 2 AS width FROM (SELECT length(trim(h)) AS n, count(*) AS c FROM {HEX} GROUP BY 1) ORDER BY c DESC, n LIMIT 1) SELECT doc_id, CASE WHEN length(trim(h)) >= width THEN right(trim(h), width) ELSE repeat('0', width - length(trim(h))) || trim(h) END AS hex FROM {HEX}, w")
def hash_hex_canonicalise(spark, sf_dir):
    """Hex of the commonest length, made even: padded on the left or cut to its last digits."""
    text = F.col("doc_id").cast("string")
    h = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" "), F.substring(F.md5(text), 1, 11))).when(F.col("doc_id") % 9 == 1, F.sha2(text, 256)).otherwise(F.md5(text))
    rows = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))
    lengths = rows.groupBy(F.length(F.trim("h")).alias("n")).count()
    width = lengths.agg(F.max_by("n", F.struct("count", -F.col("n"))).alias("n")).select((F.col("n") + F.col("n") % 2).alias("width"))
    return rows.crossJoin(F.broadcast(width)).select("doc_id", vectors.hex_canonical(F.col("h"), F.col("width")).alias("hex"))


VARIANTS = "(SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'phash_16x16' WHEN 1 THEN 'phash_' || CAST(vec_id AS VARCHAR) || 'x' || CAST(vec_id AS VARCHAR) WHEN 2 THEN 'net_e' || CAST(vec_id AS VARCHAR) || '_128d' ELSE 'dino' END AS variant FROM embeddings)"


def _variants(spark, sf_dir):
    n = F.col("vec_id").cast("string")
    by = F.col("vec_id") % 4
    variant = F.when(by == 0, "phash_16x16").when(by == 1, F.concat(F.lit("phash_"), n, F.lit("x"), n)).when(by == 2, F.concat(F.lit("net_e"), n, F.lit("_128d"))).otherwise("dino")
    return table(spark, sf_dir, "embeddings").select("vec_id", variant.alias("variant"))


@query(f"SELECT vec_id, CASE WHEN regexp_matches(variant, '^phash_') THEN (CAST(regexp_extract(variant, '_(\\d+)x', 1) AS BIGINT) * CAST(regexp_extract(variant, '_(\\d+)x', 1) AS BIGINT) + 7) // 8 WHEN regexp_matches(variant, '_\\d+d$') THEN CAST(regexp_extract(variant, '_(\\d+)d$', 1) AS BIGINT) * 4 END AS bytes FROM {VARIANTS}")
def bytes_per_card(spark, sf_dir):
    """Bytes a card takes, read from a variant's name; null where the name doesn't say."""
    side = F.regexp_extract("variant", r"_(\d+)x", 1).try_cast("bigint")
    dim = F.regexp_extract("variant", r"_(\d+)d$", 1).try_cast("bigint")
    size = F.when(F.col("variant").startswith("phash_"), vectors.hash_bytes(side)).when(dim.isNotNull(), dim * 4)
    return _variants(spark, sf_dir).select("vec_id", size.alias("bytes"))


@query(f"SELECT variant, TRY_CAST(NULLIF(regexp_extract(variant, '_e(\\d+)_(\\d+)d', 1), '') AS INTEGER) AS epoch, TRY_CAST(NULLIF(regexp_extract(variant, '_e(\\d+)_(\\d+)d', 2), '') AS INTEGER) AS dim FROM {VARIANTS}")
def variant_name_parse(spark, sf_dir):
    from lumenfold.functions import strings

    return _variants(spark, sf_dir).select("variant", strings.file_epoch(F.col("variant")).alias("epoch"), strings.file_dim(F.col("variant")).alias("dim"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS ones, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') || '00000000' AS bits FROM embeddings")
def pack_bits(spark, sf_dir):
    """Signs as bits, padded on the right to 72."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bit_count(vectors.sign_bits(F.col("embedding"))).cast("bigint").alias("ones"), vectors.pack_bits(F.col("embedding"), 72).alias("bits"))


PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance {PAIR}")
def hamming_unpacked(spark, sf_dir):
    bits = lambda c: F.transform(c, lambda x: (x > 0).cast("int"))
    return _neighbours(spark, sf_dir).select("vec_id", vectors.hamming_unpacked(bits("a"), bits("b")).cast("bigint").alias("distance"))


@query(f"SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance {PAIR}")
def hamming_packed(spark, sf_dir):
    word = lambda c: F.array(vectors.sign_bits(F.col(c)))
    return _neighbours(spark, sf_dir).select("vec_id", vectors.hamming(word("a"), word("b")).cast("bigint").alias("distance"))


@query(f"SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score {PAIR}")
def dot_raw(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / greatest(sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-8), 6) AS score {PAIR}")
def dot_clipped_norm(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", F.round(vectors.dot(F.col("a"), vectors.unit(F.col("b"), "clip")), 6).alias("score"))


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 100000000, label FROM embeddings WHERE vec_id % 100 = 0")
def gallery_append(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.unionByName(rows.where("vec_id % 100 = 0").select((F.col("vec_id") + 100000000).alias("vec_id"), "label"))


@query(f"SELECT a.vec_id, CAST(least(d(a, b), 64 - d(a, b)) AS BIGINT) AS distance {PAIR}".replace("d(a, b)", "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))"))
def min_two_orientations(spark, sf_dir):
    """The smaller of the distances to a hash and to its turned form, here the complement."""
    d = vectors.hamming(F.array(vectors.sign_bits(F.col("a"))), F.array(vectors.sign_bits(F.col("b"))))
    turned = vectors.hamming(F.array(F.bitwise_not(vectors.sign_bits(F.col("a")))), F.array(vectors.sign_bits(F.col("b"))))
    return _neighbours(spark, sf_dir).select("vec_id", F.least(d, turned).cast("bigint").alias("distance"))


@query(f"WITH {hits('cosine', 10, SEARCH, 'self')}, v AS (SELECT query_id, class, count(*) AS n FROM h GROUP BY 1, 2) SELECT query_id, class, n FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, class) = 1")
def vote_best_card(spark, sf_dir):
    """The class with the most of a query's ten neighbours."""
    votes = found(spark, sf_dir)[0].groupBy("query_id", "class").agg(F.count("*").alias("n"))
    return R.topk_per_group(votes, ["query_id"], [F.desc("n"), F.col("class")], 1).select("query_id", "class", "n")


@query(f"WITH {hits('hamming', 50, SEARCH, 'self')}, s AS (SELECT h.query_id, h.id, {COS} AS c FROM h JOIN e q ON q.id = h.query_id JOIN e g ON g.id = h.id) SELECT query_id, id, round(c, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 5")
def shortlist_rerank(spark, sf_dir):
    """Fifty by bits, then five by cosine."""
    rows = gallery(spark, sf_dir)
    short = found(spark, sf_dir, "hamming", k=50)[0].select("query_id", "id")
    both = short.join(rows.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id").join(rows.select("id", F.col("vector").alias("g")), "id")
    scored = both.select("query_id", "id", F.round(vectors.cosine(F.col("q"), F.col("g")), 12).alias("c"))
    return R.topk_per_group(scored, ["query_id"], [F.desc("c"), F.col("id")], 5).select("query_id", "id", F.round("c", 6).alias("score"))


@query(f"WITH {hits('cosine', 5, SEARCH, 'self')} SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS top FROM h GROUP BY 1")
def topk_array(spark, sf_dir):
    lists = retrieval.top_lists(found(spark, sf_dir, k=5)[0])
    return lists.select("query_id", F.array_join(F.transform("top_ids", lambda x: x.cast("string")), ",").alias("top"))


@query(f"WITH {EMB}, d AS (SELECT q.id AS query_id, g.id, {HAM} AS dist FROM e q JOIN e g ON q.id <> g.id WHERE {SEARCH}), r AS (SELECT *, row_number() OVER w AS rn, lead(dist) OVER w AS second FROM d WINDOW w AS (PARTITION BY query_id ORDER BY dist, id)) SELECT query_id, id, CAST(dist AS BIGINT) AS nearest, CAST(second AS BIGINT) AS second FROM r WHERE rn = 1 AND dist < 0.9 * second")
def lowe_ratio_filter(spark, sf_dir):
    """Nearest neighbours well ahead of the second nearest."""
    near = found(spark, sf_dir, "hamming", k=2)[0]
    pair = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("rank") == 1, -F.col("score"))).alias("nearest"), F.max(F.when(F.col("rank") == 2, -F.col("score"))).alias("second"))
    return pair.where("nearest < 0.9 * second").select("query_id", "id", F.col("nearest").cast("bigint").alias("nearest"), F.col("second").cast("bigint").alias("second"))
