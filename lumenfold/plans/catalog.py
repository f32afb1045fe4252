"""Catalog queries: lookups, slim projections, upserts, entity resolution, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import hashing, strings
from lumenfold.operators import relational as R
from lumenfold.plans.base import CARDS, FRAMES, VIDEOS, cards, frames, registrar, videos
from lumenfold.sources import table
from lumenfold.sources.scratch import scratch

REGISTRY: dict[str, tuple] = {}
query = registrar(REGISTRY)


@query(f"""
SELECT c.card_id, c.name, c.set_code, s.set_name, pr.price_usd FROM {CARDS} c
LEFT JOIN (SELECT lower(replace(p_brand, 'Brand#', 'b')) AS code, min(p_brand) AS set_name FROM part GROUP BY 1) s ON s.code = c.set_code
LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price_usd FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1) pr ON pr.l_partkey = c.card_id
""")
def catalog_lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card, left-joined to its set and to its price; cards without either stay."""
    sets = table(spark, sf_dir, "part").groupBy(F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("b"))).alias("set_code")).agg(F.min("p_brand").alias("set_name"))
    prices = table(spark, sf_dir, "lineitem").where("l_partkey % 7 <> 0").groupBy(F.col("l_partkey").alias("card_id")).agg(F.max("l_extendedprice").alias("price_usd"))
    return cards(spark, sf_dir).join(sets, "set_code", "left").join(prices, "card_id", "left").select("card_id", "name", "set_code", "set_name", "price_usd")


@query(f"SELECT card_id, name, set_code FROM {CARDS} WHERE card_id IN (1, 5, 9, 77, 150, 99999999)")
def catalog_ids_in(spark, sf_dir):
    return R.by_ids(cards(spark, sf_dir), "card_id", [1, 5, 9, 77, 150, 99999999]).select("card_id", "name", "set_code")


@query(f"SELECT card_id, name, set_code, layout FROM {CARDS} WHERE set_code IN ('b1', 'b12') AND lower(layout) = lower((SELECT min(layout) FROM {CARDS}))")
def catalog_by_set_lang(spark, sf_dir):
    """Sets and one further field, all compared without case."""
    source = cards(spark, sf_dir)
    least = source.agg(F.lower(F.min("layout")).alias("least"))
    found = source.where(F.col("set_code").isin([c.lower() for c in ("B1", "b12")]))
    return found.join(F.broadcast(least), F.lower("layout") == F.col("least")).select("card_id", "name", "set_code", "layout")


@query(f"SELECT card_id, name, set_code FROM {CARDS} WHERE lower(name) = 'small ring' AND set_code = 'b2'")
def catalog_name_set_ci(spark, sf_dir):
    return R.where_all(cards(spark, sf_dir), F.lower("name") == "SMALL Ring".lower(), F.col("set_code") == "B2".lower(), None).select("card_id", "name", "set_code")


@query(f"SELECT card_id, name FROM {CARDS} WHERE art_id = substr(sha1('small ring|' || (SELECT min(p_type) FROM part)), 1, 16)")
def catalog_by_art(spark, sf_dir):
    """Equality on an id that several cards share."""
    source = cards(spark, sf_dir)
    wanted = source.agg(hashing.art_id(F.lit("small ring"), F.min("layout")).alias("art_id"))
    return source.join(F.broadcast(wanted), "art_id", "left_semi").select("card_id", "name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_id % 97 = 0) THEN 1 ELSE 0 END AS is_default FROM events WHERE event_type <> 'error'")
def catalog_slim_from_json(spark, sf_dir):
    """A field of nested JSON, skipping a status, with a 0/1 flag of membership in a set of defaults."""
    parsed = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint").getField("k"))
    defaults = parsed.where("event_id % 97 = 0").select("k").distinct().withColumn("d", F.lit(1))
    return parsed.where("event_type <> 'error'").join(defaults, "k", "left").select("event_id", "k", F.coalesce("d", F.lit(0)).alias("is_default"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS status FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, '') NOT IN ('error', 'view')")
def catalog_status_not_in_null_safe(spark, sf_dir):
    """NOT IN that nulls pass."""
    status = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).where(~F.coalesce("status", F.lit("")).isin("error", "view"))


@query(f"SELECT set_code, arg_min(name, card_id) AS first_name FROM {CARDS} GROUP BY 1")
def sets_first_seen(spark, sf_dir):
    return R.first_write(cards(spark, sf_dir).select("set_code", "card_id", "name"), ["set_code"], ["card_id"]).select("set_code", F.col("name").alias("first_name"))


@query(f"SELECT card_id, arg_max(matches, seq) AS matches, max(seq) AS seq FROM {FRAMES} GROUP BY 1")
def cards_last_write(spark, sf_dir):
    return R.last_write(frames(spark, sf_dir).select("card_id", "matches", "seq"), ["card_id"], ["seq"])


@query("""
WITH old AS (SELECT p_partkey AS card_id, TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS price FROM part),
     new AS (SELECT p_partkey AS card_id, CAST(p_size * 2 AS DOUBLE) AS price FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey + 100000000, NULL FROM part WHERE p_partkey % 50 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE card_id NOT IN (SELECT card_id FROM new)
""")
def price_parse_upsert(spark, sf_dir):
    """Prices parsed from text, null where they don't parse, then replaced by key."""
    part = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    old = part.select(F.col("p_partkey").alias("card_id"), strings.parse_price(text).alias("price"))
    new = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("card_id"), (F.col("p_size") * 2).cast("double").alias("price"))
    more = part.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 100000000).alias("card_id"), F.lit(None).cast("double").alias("price"))
    return R.upsert(old, new.unionByName(more), ["card_id"])


@query(f"SELECT count(*) AS n, count(price) AS with_price, CAST(count_if(price > 1000) AS BIGINT) AS dear FROM {CARDS}")
def price_counts(spark, sf_dir):
    return cards(spark, sf_dir).agg(F.count("*").alias("n"), F.count("price").alias("with_price"), F.count_if(F.col("price") > 1000).alias("dear"))


RECORDS = "(SELECT o_orderkey AS record_id, lower(p_name) AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE lower(replace(p_brand, 'Brand#', 'b')) END AS set_code FROM orders JOIN part ON p_partkey = o_custkey % 2000)"
RESOLVED = f"""(SELECT r.record_id, count(c.card_id) AS n,
       CASE WHEN count(c.card_id) = 0 THEN 'not_found' WHEN count(c.card_id) = 1 THEN 'resolved'
            WHEN count(DISTINCT NULLIF(c.art_id, '')) = 1 THEN 'ambiguous_same_art' ELSE 'ambiguous' END AS status,
       min(c.card_id) AS first_card
  FROM {RECORDS} r LEFT JOIN {CARDS} c ON lower(c.name) = r.name AND c.set_code = r.set_code GROUP BY 1)"""


def _resolved(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("b"))).alias("code"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 2000).alias("p_partkey"))
    records = orders.join(part, "p_partkey").select("record_id", "name", F.when(F.col("record_id") % 11 == 0, "none").otherwise(F.col("code")).alias("set_code"))
    return R.resolve(records, cards(spark, sf_dir).withColumn("name", F.lower("name")), ["name", "set_code"], "record_id", "card_id", "art_id")


@query(f"SELECT record_id, n, status, CASE WHEN status IN ('resolved', 'ambiguous_same_art') THEN first_card END AS card_id FROM {RESOLVED}")
def resolve_ambiguity(spark, sf_dir):
    """Records to cards by name and set, with the kind of ambiguity."""
    return _resolved(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM {RESOLVED} GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM {RESOLVED}")
def resolve_status_counts(spark, sf_dir):
    rolled = _resolved(spark, sf_dir).rollup("status").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("status", F.lit("total")).alias("status"), "n")


@query("SELECT p_partkey AS card_id, CASE WHEN contains(p_name, 'red') THEN 'substring' WHEN p_size % 10 IN (3, 7) THEN 'suffix' END AS reason FROM part")
def known_bad_reason(spark, sf_dir):
    """Exclusion with its reason: substrings first, then the suffix after the last underscore."""
    stem = F.concat(F.col("p_name"), F.lit("_"), (F.col("p_size") % 10).cast("string"))
    reason = F.when(stem.contains("red"), "substring").when(F.substring_index(stem, "_", -1).isin("3", "7"), "suffix")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), reason.alias("reason"))


HOSTS = "(SELECT n_name AS host_set, unnest(['Small Ring', 'red widget', 'no such card', 'BLUE bolt']) AS name, n_nationkey FROM nation)"


@query(f"SELECT host_set, string_agg(DISTINCT CAST(card_id AS VARCHAR), ',' ORDER BY CAST(card_id AS VARCHAR)) AS cards FROM {HOSTS} h JOIN {CARDS} c ON lower(c.name) = lower(h.name) AND c.number % 25 = n_nationkey GROUP BY 1")
def host_set_name_resolution(spark, sf_dir):
    """Names of each host set to card ids, one to many, without case, as sorted lists."""
    names = F.array(*[F.lit(x) for x in ("Small Ring", "red widget", "no such card", "BLUE bolt")])
    hosts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("host_set"), "n_nationkey", F.explode(F.transform(names, F.lower)).alias("name"))
    found = hosts.join(cards(spark, sf_dir).select("card_id", F.lower("name").alias("name"), (F.col("number") % 25).alias("n_nationkey")), ["name", "n_nationkey"])
    return found.groupBy("host_set").agg(F.array_join(F.sort_array(F.collect_set(F.col("card_id").cast("string"))), ",").alias("cards"))


QUERY_FILES = "(SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST(user_id % 400 * 7 AS VARCHAR), 12, '0') AS stem, user_id % 400 * 7 AS card FROM events)"


def _query_files(spark, sf_dir):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    card = F.col("user_id") % 400 * 7
    name = F.concat(F.lit("IMG_"), F.upper(F.concat(pad(F.col("event_id"), 8), F.lit("-0000-4000-8000-"), pad(card, 12))), F.lit(".jpg"))
    files = table(spark, sf_dir, "events").select("event_id", name.alias("file"))
    uuid = strings.extract_uuid(F.col("file"))
    return files.select("event_id", uuid.alias("uuid"), F.substring(uuid, 25, 12).cast("bigint").alias("card_id"))


@query(f"SELECT event_id, stem AS uuid, c.card_id, c.art_id FROM {QUERY_FILES} JOIN {CARDS} c ON c.card_id = card")
def query_manifest_join(spark, sf_dir):
    """Ids read from file names, joined to the catalog; misses drop out."""
    return _query_files(spark, sf_dir).join(cards(spark, sf_dir).select("card_id", "art_id"), "card_id").select("event_id", "uuid", "card_id", "art_id")


@query(f"SELECT count(*) AS misses FROM {QUERY_FILES} WHERE card NOT IN (SELECT card_id FROM {CARDS})")
def query_manifest_misses(spark, sf_dir):
    return _query_files(spark, sf_dir).join(cards(spark, sf_dir), "card_id", "left_anti").agg(F.count("*").alias("misses"))


FRACTION = "CAST(CAST('0x' || substr(sha256('7:' || {c}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295.0"
SPLIT = "CASE WHEN " + FRACTION + " < 0.8 THEN 'train' WHEN " + FRACTION + " < 0.9 THEN 'val' ELSE 'test' END"


@query(f"SELECT card_id, {SPLIT.format(c='art_id')} AS split FROM {CARDS}")
def manifest_split_sha256(spark, sf_dir):
    """A split by art, the same in every run and engine."""
    return cards(spark, sf_dir).select("card_id", hashing.split_of(F.col("art_id"), "7", 0.8, 0.1).alias("split"))


@query(f"SELECT card_id, art_id FROM {CARDS}")
def illustration_id_sha1(spark, sf_dir):
    return cards(spark, sf_dir).select("card_id", "art_id")


@query(f"SELECT card_id, art_id, source FROM (SELECT card_id, art_id, 'a' AS source FROM {CARDS} UNION ALL SELECT card_id, art_id, 'b' FROM {CARDS} WHERE number > 25) QUALIFY count(*) OVER (PARTITION BY art_id) >= 6")
def manifest_min_samples(spark, sf_dir):
    """Two manifests together; only classes with enough rows stay."""
    source = cards(spark, sf_dir)
    both = source.select("card_id", "art_id", F.lit("a").alias("source")).unionByName(source.where("number > 25").select("card_id", "art_id", F.lit("b").alias("source")))
    return R.at_least(both, ["art_id"], 6).select("card_id", "art_id", "source")


@query(f"""
WITH m AS (SELECT art_id, {SPLIT.format(c='art_id')} AS split FROM {CARDS})
SELECT split, count(*) AS n, count(DISTINCT art_id) AS classes FROM m GROUP BY 1
UNION ALL SELECT 'train and val', count(*), count(*) FROM (SELECT art_id FROM m WHERE split = 'train' INTERSECT SELECT art_id FROM m WHERE split = 'val')
""")
def split_counts_and_leak(spark, sf_dir):
    """Rows and classes of each split, and the classes that two of them share: none."""
    m = cards(spark, sf_dir).select("art_id", hashing.split_of(F.col("art_id"), "7").alias("split"))
    counts = m.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("art_id").alias("classes"))
    shared = m.where("split = 'train'").select("art_id").intersect(m.where("split = 'val'").select("art_id"))
    return counts.unionByName(shared.agg(F.lit("train and val").alias("split"), F.count("*").alias("n"), F.count("*").alias("classes")))


@query(f"SELECT f.video_id, f.line, f.card_id, coalesce(c.name, 'unknown') AS name, coalesce(c.set_code, '') AS set_code FROM {FRAMES} f JOIN {VIDEOS} v ON v.video_id = f.video_id LEFT JOIN (SELECT * FROM {CARDS} WHERE card_id % 3 <> 0) c ON c.card_id = f.card_id WHERE v.status = 'done' AND f.dist BETWEEN 0 AND 20 AND f.area >= 0.02")
def manifest_export_join(spark, sf_dir):
    """Frames of finished videos with optional filters, and card fields with fallbacks."""
    usable = R.where_all(frames(spark, sf_dir), F.col("dist").between(0, 20), F.col("area") >= 0.02, None)
    known = cards(spark, sf_dir).where("card_id % 3 <> 0").select("card_id", "name", "set_code")
    done = videos(spark, sf_dir).where("status = 'done'")
    return usable.join(done, "video_id", "left_semi").join(known, "card_id", "left").select("video_id", "line", "card_id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("set_code", F.lit("")).alias("set_code"))


@query("SELECT p_partkey AS card_id, CASE WHEN p_name IN ('small ring') THEN 'train' WHEN p_name IN ('red widget') THEN 'val' WHEN substr(p_name, 1, 1) IN ('b', 'h') THEN 'val' ELSE 'train' END AS split FROM part")
def val_split_override(spark, sf_dir):
    """Lists override the rule by first letter."""
    name = F.col("p_name")
    split = F.when(name.isin("small ring"), "train").when(name.isin("red widget"), "val").when(F.substring(name, 1, 1).isin("b", "h"), "val").otherwise("train")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), split.alias("split"))


@query(f"SELECT card_id, CAST(dense_rank() OVER (ORDER BY set_code) - 1 AS BIGINT) AS label FROM {CARDS} WHERE name <> ''")
def label_index_dense(spark, sf_dir):
    """Sorted distinct labels numbered from 0."""
    source = cards(spark, sf_dir).where("name <> ''")
    labels = R.dense_index(source, "set_code", "label", scratch(spark, "labels"))
    return source.join(labels, "set_code").select("card_id", "label")


@query(f"SELECT video_id, line, dist FROM {FRAMES} WHERE dist BETWEEN 3 AND 12 AND matches IS NOT NULL")
def frames_phash_filter_excl_null(spark, sf_dir):
    """A range that nulls don't pass."""
    return frames(spark, sf_dir).where(F.col("dist").between(3, 12) & F.col("matches").isNotNull()).select("video_id", "line", "dist")


@query(f"SELECT video_id, line, dist FROM {FRAMES} WHERE dist IS NULL OR dist <= 3")
def frames_phash_filter_incl_null(spark, sf_dir):
    """A range that nulls pass; a negative limit would be no filter."""
    most = 3
    kept = F.col("dist").isNull() | (F.col("dist") <= most) if most >= 0 else None
    return R.where_all(frames(spark, sf_dir), kept).select("video_id", "line", "dist")


@query(f"SELECT DISTINCT set_code, layout FROM {CARDS}")
def distinct_sets_by_lang(spark, sf_dir):
    return cards(spark, sf_dir).select("set_code", "layout").distinct()


@query(f"SELECT layout, string_agg(DISTINCT set_code, ',' ORDER BY set_code) AS sets FROM {CARDS} GROUP BY 1")
def merge_group_lists(spark, sf_dir):
    """Comma lists of several pages, merged into one sorted list a key."""
    pages = cards(spark, sf_dir).groupBy("layout", (F.col("card_id") % 4).alias("page")).agg(F.array_join(F.sort_array(F.collect_set("set_code")), ", ").alias("sets"))
    each = pages.select("layout", F.explode(strings.tokens(F.col("sets"))).alias("set_code"))
    return each.groupBy("layout").agg(F.array_join(F.sort_array(F.collect_set("set_code")), ",").alias("sets"))


@query(f"SELECT art_id, count(*) AS cards, count(DISTINCT set_code) AS sets FROM {CARDS} GROUP BY 1")
def group_by_two_keys(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("art_id").agg(F.count("*").alias("cards"), F.countDistinct("set_code").alias("sets"))


@query(f"SELECT card_id, name FROM {CARDS} WHERE lower(set_code) = 'b7'")
def lang_set_filter_all(spark, sf_dir):
    """Filters of which 'all' is none."""
    wanted, layout = "B7", "all"
    by = lambda c, v: None if v == "all" else F.lower(c) == v.lower()
    return R.where_all(cards(spark, sf_dir), by("set_code", wanted), by("layout", layout)).select("card_id", "name")


@query(f"SELECT card_id, 'front' AS face, set_code || '/' || CAST(card_id AS VARCHAR) || '.png' AS path FROM {CARDS} WHERE number % 4 <> 0 AND layout <> (SELECT min(layout) FROM {CARDS}) UNION ALL SELECT card_id, 'back', set_code || '/' || CAST(card_id AS VARCHAR) || '_b.png' FROM {CARDS} WHERE number % 6 = 0 AND layout <> (SELECT min(layout) FROM {CARDS})")
def face_expand(spark, sf_dir):
    """None, one or two faces a card, with one layout left out."""
    source = cards(spark, sf_dir)
    least = source.agg(F.min("layout").alias("layout"))
    stem = F.concat(F.col("set_code"), F.lit("/"), F.col("card_id").cast("string"))
    front = F.struct(F.lit("front").alias("face"), F.when(F.col("number") % 4 != 0, F.concat(stem, F.lit(".png"))).alias("path"))
    back = F.struct(F.lit("back").alias("face"), F.when(F.col("number") % 6 == 0, F.concat(stem, F.lit("_b.png"))).alias("path"))
    faces = F.filter(F.array(front, back), lambda f: f["path"].isNotNull())
    return source.join(F.broadcast(least), "layout", "left_anti").select("card_id", F.explode(faces).alias("f")).select("card_id", "f.face", "f.path")


@query("SELECT event_id, event_type AS status FROM events WHERE event_type IN ('purchase', 'click')")
def usable_status(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click")).select("event_id", F.col("event_type").alias("status"))


@query(f"SELECT card_id, name FROM {CARDS}")
def public_fields(spark, sf_dir):
    return R.public_fields(cards(spark, sf_dir).select("card_id", "name", F.col("price").alias("_price"), F.col("art_id").alias("_art")))


@query(f"SELECT f.video_id, f.line, coalesce(CASE WHEN f.line % 2 = 0 THEN NULLIF(CASE WHEN f.matches > 25 THEN 'own' ELSE '' END, '') END, c.art_id, '') AS art_id FROM {FRAMES} f LEFT JOIN {CARDS} c ON c.card_id = f.card_id")
def class_fallback_coalesce(spark, sf_dir):
    """A frame's own class, else its card's, else empty."""
    own = F.when(F.col("line") % 2 == 0, strings.non_empty(F.when(F.col("matches") > 25, "own").otherwise("")))
    return frames(spark, sf_dir).join(cards(spark, sf_dir).select("card_id", "art_id"), "card_id", "left").select("video_id", "line", F.coalesce(own, "art_id", F.lit("")).alias("art_id"))


@query(f"SELECT a.card_id, min(b.card_id) AS twin FROM {CARDS} a JOIN {CARDS} b ON a.set_code = b.set_code AND a.number = b.number GROUP BY 1")
def composite_key_lookup(spark, sf_dir):
    """Lookup by set and collector number; the first card of a pair of keys stands for it."""
    source = cards(spark, sf_dir)
    keyed = source.groupBy("set_code", "number").agg(F.min("card_id").alias("twin"))
    return source.join(keyed, ["set_code", "number"]).select("card_id", "twin")


@query(f"SELECT f.video_id, f.line FROM {FRAMES} f WHERE EXISTS (SELECT 1 FROM {FRAMES} g WHERE g.card_id = f.card_id AND (g.dist IS NULL OR g.dist <= 2))")
def allowed_paths_semi(spark, sf_dir):
    source = frames(spark, sf_dir)
    allowed = source.where("dist is null or dist <= 2").select("card_id").distinct()
    return source.join(allowed, "card_id", "left_semi").select("video_id", "line")


@query("SELECT user_id, arg_min(path, CASE WHEN contains(path, '/front/') THEN 'a' ELSE 'b' END || path) AS path FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN '/x/front/' ELSE '/x/back/' END || lpad(CAST(event_id AS VARCHAR), 9, '0') AS path FROM events) GROUP BY 1")
def image_pick_priority(spark, sf_dir):
    """A front image if there is one, else the first."""
    path = F.concat(F.when(F.col("event_id") % 4 == 0, "/x/front/").otherwise("/x/back/"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    listed = table(spark, sf_dir, "events").select("user_id", path.alias("path"))
    return listed.groupBy("user_id").agg(F.min_by("path", F.struct((~F.col("path").contains("/front/")).cast("int").alias("p"), "path")).alias("path"))


@query("SELECT vec_id AS row_idx, label, 'card-' || CAST(vec_id AS VARCHAR) AS card_id FROM embeddings")
def gallery_zip_by_row_idx(spark, sf_dir):
    """Two row lists zipped by an explicit index; unequal lengths would leave nulls that the assertion finds."""
    source = table(spark, sf_dir, "embeddings")
    names = source.select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("card-"), F.col("vec_id").cast("string")).alias("card_id"))
    rows = source.select(F.col("vec_id").alias("row_idx"), "label")
    both = rows.join(names, "row_idx", "full")
    return both.where(F.assert_true(F.col("label").isNotNull() & F.col("card_id").isNotNull()).isNull())


@query(f"SELECT card_id, set_code || CAST(number AS VARCHAR) AS key, CAST(count(*) OVER (PARTITION BY set_code, number) AS BIGINT) AS twins FROM {CARDS}")
def composite_twins(spark, sf_dir):
    source = cards(spark, sf_dir)
    counts = source.groupBy("set_code", "number").agg(F.count("*").alias("twins"))
    return source.join(counts, ["set_code", "number"]).select("card_id", F.concat("set_code", F.col("number").cast("string")).alias("key"), "twins")
