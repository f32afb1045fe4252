"""Registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import centroids, chat, decontam, langid, license, lm, media, neardup, packing, pii, ranking, tokencount, vectorgraph
from lumenfold.sources import table


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm.score_texts(table(spark, sf_dir, "documents"), held_out)


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_digests(chats, public_tokenizers.path("piece_bpe_32k.model"))


def op6_picture_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds pictures: each embedding is rendered as one, and every twentieth also cropped and darkened."""
    pictures = media.rendered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.picture_copies(pictures).withColumnRenamed("id", "picture_id")


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(table(spark, sf_dir, "documents")))


def op10_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_rank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    mixed = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    grouped = lambda c: F.when(mixed, -1).otherwise(c)
    month = F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))
    hundredths = lambda c: F.floor(100 * F.col(c) + 0.5)
    groups = {"vendor_id": grouped(F.col("vendor_id")), "part": grouped(F.coalesce(F.col("item_id") % 5, F.lit(-1))), "month": grouped(month)}
    pair = {"tens": (F.floor(F.col("quantity") / 10), True), "percent": (hundredths("discount"), False)}
    then = {"sale_id": (F.col("sale_id"), False), "line_no": (F.col("line_no"), False), "quantity": (F.col("quantity"), False), "amount_cents": (hundredths("amount"), False)}
    return ranking.first_places(lines, groups, pair, then, k=2).select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


def op13_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack_documents, op2_identify_language, op3_near_duplicates, op4_score_texts, op5_format_chats, op6_picture_copies, op7_count_tokens, op8_find_leaks, op9_find_personal_data, op10_scan_licenses, op11_near_vectors, op12_rank_lines, op13_cluster_vectors)}

# Over all words and all pairs of documents that share a shingle, which small tables allow.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN roots ON node = w.doc_id
"""

# Every placement of every item at every document, by the words that they have in common.
LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, len(words) AS dn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, len(words) AS n, least(13, len(words)) AS width, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS q FROM b),
equal AS (SELECT doc_id, item_id, p - q AS placed, p, width, greatest(0, p - q) AS low, least(dn, p - q + n) AS high FROM dw JOIN bw ON bw.word = dw.word),
near AS (SELECT * FROM equal QUALIFY 100 * count(*) OVER (PARTITION BY doc_id, item_id, placed) >= 80 * width),
windows AS (
  SELECT doc_id, item_id, placed, width, s FROM (SELECT *, unnest(generate_series(greatest(p - width + 1, low), least(p, high - width))) AS s FROM near)
   GROUP BY ALL HAVING 100 * count(*) >= 80 * width),
spans AS (SELECT doc_id, item_id, placed, min(s) AS first, max(s + width) AS last FROM windows GROUP BY ALL),
found AS (SELECT doc_id, item_id, first, last - first AS n_words, count(*) AS matched FROM spans JOIN near USING (doc_id, item_id, placed) WHERE p >= first AND p < last GROUP BY doc_id, item_id, placed, first, last)
SELECT doc_id, item_id, first AS start_word, n_words, matched, matched / n_words AS similarity
  FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, first, n_words DESC) = 1
"""

# All pairs of a label.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS node, b AS root FROM p UNION SELECT r.node, p.b FROM reach r JOIN p ON p.a = r.root),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, root) AS component_id, vec_id = least(vec_id, root) AS kept
  FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN roots ON node = vec_id
"""

# CRC-32 of a number's decimal text, bit by bit; the polynomial is a fixed value.
RANKS_SQL = r"""
WITH codes AS (SELECT sale_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, _: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS crc
    FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
l AS (SELECT coalesce(crc % 5 = 0, false) AS mixed, vendor_id, coalesce(item_id % 5, -1) AS part, coalesce(100 * year(shipped_at) + month(shipped_at), -1) AS month,
    sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(quantity / 10)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, floor(100 * amount + 0.5)::BIGINT AS amount_cents
    FROM sale_lines LEFT JOIN codes USING (sale_id)),
g AS (SELECT CASE WHEN mixed THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN mixed THEN -1 ELSE part END AS part, CASE WHEN mixed THEN -1 ELSE month END AS month,
    sale_id, line_no, quantity, tens, percent, amount_cents FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM g)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= 2
"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as a table of its own."""
    squares = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    assign = lambda r: f"a{r} AS MATERIALIZED (SELECT row, vec_id, v, cluster, {squares} AS distance FROM kept, c{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"
    means = lambda r: (
        f"s{r} AS (SELECT cluster, i, sum(v[i])::BIGINT AS t, count(*) AS n FROM a{r}, range(1, 65) AS x(i) GROUP BY cluster, i), "
        f"m{r} AS (SELECT cluster, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster), "
        f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"
    )
    steps = ", ".join(f"{assign(r)}, {means(r)}" for r in range(rounds))
    return f"""
WITH fine AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM fine),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c FROM kept QUALIFY cluster < {k}),
{steps}, {assign(rounds)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
  FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": NEAR_DUPLICATES_SQL, "op8_find_leaks": LEAKS_SQL, "op11_near_vectors": VECTORS_SQL, "op12_rank_lines": RANKS_SQL, "op13_cluster_vectors": _clusters_sql()}
