"""String, path, hash, date and number functions over names, URLs and rows of the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import hashing, strings, wiki
from lumenfold.plans.base import CARDS, cards, registrar
from lumenfold.sources import table

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query(r"SELECT doc_id, CAST(doc_id AS VARCHAR) || '_' || left(lower(array_to_string(list_filter(list_filter(string_split(regexp_replace(title, '[^A-Za-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '')[1:5], lambda w: length(w) > 1), '-')), 40) AS slug FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Mystic-Box (a 2X)' || chr(9) ELSE '' END || split_part(text, chr(10), 1) AS title FROM documents)")
def slug_video(spark, sf_dir):
    title = F.concat(F.when(F.col("doc_id") % 2 == 0, "Mystic-Box (a 2X)\t").otherwise(""), F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", strings.video_slug(F.col("doc_id"), title).alias("slug"))


@query(f"""SELECT card_id, trim(regexp_replace(regexp_replace(lower(name || ' // ' || layout), '[''",.!?:]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {CARDS}""")
def slug_card_name(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", strings.name_slug(F.concat("name", F.lit(" // "), "layout")).alias("slug"))


@query(r"SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS part, NULLIF(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([A-Za-z0-9]+)$', 1), '') AS extension, TRY_CAST(split_part(url, '?', 2) AS BIGINT) AS epoch FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    part = lambda i: F.split_part(u, F.lit("/"), F.lit(i))
    return pages(spark, sf_dir).select("page_id", part(3).alias("host"), part(4).alias("part"), strings.url_extension(u).alias("extension"), strings.url_epoch(u).alias("epoch"))


@query(r"SELECT page_id, coalesce(NULLIF(regexp_extract(u, '@([^/?#]+)', 1), ''), regexp_extract(rtrim(u, '/'), '[^/]*$', 0)) AS channel FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://v.example/@chan' || CAST(page_id AS VARCHAR) || '/videos' ELSE url || '/' END AS u FROM pages)")
def channel_from_url(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://v.example/@chan"), F.col("page_id").cast("string"), F.lit("/videos"))).otherwise(F.concat("url", F.lit("/")))
    return pages(spark, sf_dir).select("page_id", strings.channel_name(u).alias("channel"))


@query(r"SELECT p_partkey AS id, array_to_string(list_filter(string_split_regex(lower(trim(p_name || ', ' || p_type || ' ,')), '[\s,]+'), lambda x: x <> ''), '+') AS tokens FROM part")
def token_split(spark, sf_dir):
    c = F.concat("p_name", F.lit(", "), "p_type", F.lit(" ,"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(strings.tokens(c), "+").alias("tokens"))


@query(f"SELECT card_id, '/img/' || substr(art_id, 1, 1) || '/' || substr(art_id, 2, 1) || '/' || art_id || '.png' AS path, '/img/' || 'x/x/.png' AS none FROM {CARDS}")
def sharded_path(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", strings.sharded_path("/img", F.col("art_id"), "png").alias("path"), strings.sharded_path("/img", F.lit(""), "png").alias("none"))


@query(f"SELECT card_id, CASE WHEN number % 5 = 0 THEN '' ELSE printf('%04d', number % 5 * 7) END AS padded FROM {CARDS}")
def zero_pad(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", strings.zero_pad(F.col("number") % 5 * 7).alias("padded"))


@query("SELECT event_id, CASE WHEN regexp_matches(props, '[\",\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS escaped FROM events")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", strings.csv_escape(F.col("props")).alias("escaped"))


@query("SELECT event_id, props AS body FROM events")
def strip_fences(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```\n"))
    return table(spark, sf_dir, "events").select("event_id", strings.strip_fences(F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.col("props"))).alias("body"))


@query(f"SELECT card_id, CASE WHEN number % 3 = 0 THEN '/fast/a/' WHEN number % 3 = 1 THEN '/fast/b/' ELSE '/other/' END || art_id || '.jpg' AS path FROM {CARDS}")
def path_remap(spark, sf_dir):
    old = F.when(F.col("number") % 3 == 0, "/slow/a/").when(F.col("number") % 3 == 1, "/slow/b/").otherwise("/other/")
    path = F.concat(old, "art_id", F.lit(".png"))
    return cards(spark, sf_dir).select("card_id", strings.remap_path(path, [("/slow/a/", "/fast/a/"), ("/slow/b/", "/fast/b/")], ".jpg").alias("path"))


@query("SELECT event_id, ts > TIMESTAMP '2024-01-15 12:00:00' AS newer, date_diff('day', ts, TIMESTAMP '2024-02-01') > 20 AS stale FROM events")
def iso_timestamp_newer(spark, sf_dir):
    """ISO text against a timestamp, and an age in whole days."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    limit = F.to_timestamp(F.lit("2024-01-15T12:00:00Z"))
    return table(spark, sf_dir, "events").select("event_id", strings.newer_than(iso, limit).alias("newer"), (F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")) > 20).alias("stale"))


@query(f"SELECT card_id, split_part(art_id || '_x_y', '_', 1) AS id FROM {CARDS}")
def id_before_underscore(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", strings.id_before_underscore(F.concat("art_id", F.lit("_x_y"))).alias("id"))


@query(f"SELECT card_id, CASE WHEN number % 4 = 0 THEN NULL ELSE 'k' || CAST(number AS VARCHAR) END AS name, CASE WHEN number % 4 = 0 THEN NULL ELSE 'a=b' END AS value FROM {CARDS}")
def kv_parse(spark, sf_dir):
    text = F.when(F.col("number") % 4 == 0, "nothing").otherwise(F.concat(F.lit("k"), F.col("number").cast("string"), F.lit("=a=b")))
    name, value = strings.key_value(text)
    return cards(spark, sf_dir).select("card_id", name.alias("name"), value.alias("value"))


@query(f"SELECT card_id, 'a\\|' || name AS cell FROM {CARDS}")
def md_escape(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", strings.md_escape(F.concat(F.lit("a|"), "name")).alias("cell"))


@query(f"SELECT card_id, CASE WHEN number % 3 = 0 THEN 0 ELSE number END AS first FROM {CARDS}")
def first_or_zero(spark, sf_dir):
    numbers = F.when(F.col("number") % 3 == 0, F.expr("cast(array() as array<int>)")).otherwise(F.array("number"))
    return cards(spark, sf_dir).select("card_id", F.coalesce(F.get(numbers, F.lit(0)), F.lit(0)).alias("first"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN f < 0.8 THEN 'train' WHEN f < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT CAST(CAST('0x' || substr(sha256('x:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295.0 AS f FROM orders)) GROUP BY 1")
def split_80_10_10(spark, sf_dir):
    split = hashing.split_of(F.col("o_orderkey").cast("string"), "x")
    return table(spark, sf_dir, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT set_code, sha1(string_agg(art_id, ',' ORDER BY art_id)) AS print, substr(md5(set_code), 1, 12) AS short FROM {CARDS} GROUP BY 1")
def fingerprint(spark, sf_dir):
    lists = F.array_join(F.sort_array(F.collect_list("art_id")), ",")
    return cards(spark, sf_dir).groupBy("set_code").agg(F.sha1(lists).alias("print"), F.substring(F.md5(F.first("set_code")), 1, 12).alias("short"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events")
def run_id_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("run_id"))


# what halves do is written out for SQL: to the even digit, over decimals
def _half_even(x, places):
    d, unit = f"CAST({x} AS DECIMAL(28, 12))", f"1{'0' * places}"
    return f"CAST(CASE WHEN abs({d} * {unit} - trunc({d} * {unit})) = 0.5 THEN 2 * round({d} * {unit} / 2) ELSE round({d} * {unit}) END AS DOUBLE) / {unit}"


@query(f"SELECT event_id, {_half_even('value / 8', 1)} AS ms, {_half_even('value / 8', 3)} AS ms_fine, {_half_even('value / 512', 4)} AS confidence FROM events")
def round_ms(spark, sf_dir):
    """Milliseconds to one or three places and confidences to four; halves go to the even digit."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", strings.round_half_even(value / 8, 1).alias("ms"), strings.round_half_even(value / 8, 3).alias("ms_fine"), strings.round_half_even(value / 512, 4).alias("confidence"))


@query("SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS sigmoid, round(exp(CAST(embedding[1] AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS soft FROM embeddings")
def sigmoid_softmax(spark, sf_dir):
    x = F.col("embedding")[0].cast("double")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + F.exp(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-x)), 6).alias("sigmoid"), F.round(F.exp(x) / total, 6).alias("soft"))


@query("SELECT doc_id, CAST(list_max(list_filter([n_chars % 1000, n_chars % 700, n_chars % 1300], lambda h: h > 0 AND h < 1080)) AS BIGINT) AS height FROM documents")
def max_height_filter(spark, sf_dir):
    heights = F.array(*[F.col("n_chars") % m for m in (1000, 700, 1300)])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_max(F.filter(heights, lambda h: (h > 0) & (h < 1080))).alias("height"))


@query("SELECT event_id, props AS decoded, length(props) AS n FROM events")
def base64_decode(spark, sf_dir):
    data = F.unbase64(F.base64(F.encode("props", "UTF-8")))
    return table(spark, sf_dir, "events").select("event_id", F.decode(data, "UTF-8").alias("decoded"), F.octet_length(data).cast("bigint").alias("n"))


@query(f"SELECT set_code, string_agg(DISTINCT lower(layout), '_' ORDER BY lower(layout)) || '_en' AS key FROM {CARDS} GROUP BY 1")
def cache_key(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("set_code").agg(strings.cache_key(F.collect_set(F.lower("layout")), F.lit("en")).alias("key"))


@query(f"SELECT card_id, CASE WHEN number % 5 = 0 THEN 'Unknown' ELSE name END || ' [' || CASE WHEN number % 7 = 0 THEN '?' ELSE upper(set_code) END || '] (Unknown)' AS label FROM {CARDS}")
def card_label(spark, sf_dir):
    name, code = F.when(F.col("number") % 5 != 0, F.col("name")), F.when(F.col("number") % 7 != 0, F.col("set_code")).otherwise("")
    return cards(spark, sf_dir).select("card_id", strings.card_label(name, code, F.lit(None).cast("string")).alias("label"))


@query("SELECT o_orderkey AS id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS at FROM (SELECT o_orderkey, o_orderkey * 37 % 20000 AS s FROM orders)")
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), strings.clock(F.col("o_orderkey") * 37 % 20000).alias("at"))


@query("SELECT event_id, CASE WHEN t IN ('1', 'true', 'yes') THEN true WHEN t IN ('0', 'false', 'no') THEN false END AS flag FROM (SELECT event_id, (['1', 'true', 'yes', '0', 'no', 'maybe'])[event_id % 6 + 1] AS t FROM events)")
def truthy_parse(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("1", "TRUE", " yes", "0", "No", "maybe")])
    return table(spark, sf_dir, "events").select("event_id", strings.to_bool(F.get(words, (F.col("event_id") % 6).cast("int"))).alias("flag"))


@query("SELECT doc_id, contains(text, 'content') OR contains(text, 'filter') OR contains(text, 'the ') AS hit FROM documents")
def three_substring_test(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (t.contains("content") | t.contains("filter") | t.contains("the ")).alias("hit"))


# Each customer makes up a page in the sources' layouts; what a reader of the page gets is stated from the rules of its making.
ENTRY_PAGE = """{| class="wikitable"
! Host set !! Original set !! Number !! Card !! Note
|-
| MKM
| %1$s
| %2$d
| {{card|%1$s||PLIST}}
| %2$d
|-
! not a cell
|-
| Host set
| {{card|Header}}
|-
| otj
| no card here
|}
{|
|-
|MH3
|M3C
| {{card|%1$s two|set=%2$d}} and {{card|never}}
|-
| {{card|alone}}
|}"""


@query("SELECT c_custkey, unnest(['mkm', 'mh3']) AS host_set, unnest([c_name, c_name || ' two']) AS name FROM customer")
def wiki_row_entries(spark, sf_dir):
    """Host sets and cards of pages with a row for each entry."""
    page = F.format_string(ENTRY_PAGE, "c_name", "c_nationkey")
    found = table(spark, sf_dir, "customer").select("c_custkey", F.explode(wiki.row_entries(page)).alias("entry"))
    return found.select("c_custkey", "entry.host_set", "entry.name")
