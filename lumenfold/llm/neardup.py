"""Near-duplicate groups by bottom-k sketches from one hash function.

1. Each text becomes its set of 5-word shingle hashes; equal sets are one class from here on (copies are never
   paired), known by its smallest id. A class's short sketch is the k smallest hashes of its set.
2. Inverted lists of the values in short sketches: a class of which fewer than ``overlap_for`` values are retained by
   any other class has no near duplicate and is done with. That settles most classes.
3. The rest retain up to ``long_k`` of their smallest hashes, nearly always the whole set, in inverted lists again.
   Sets that are similar enough share a value among the rarest few of both: among the first n - overlap + 1 of n in
   order of frequency, and, for a given pair of sizes, among fewer still. Only these are listed, with their places, so
   that common passages, being frequent, are hardly ever listed.
4. Stars: within each list, every class is compared with the list's most central class only. Groups of thousands of
   near copies fall together in a linear number of comparisons. Then all pairs of a list that are still in different
   components, and whose sizes and places allow it, are compared: no link that could join two components is left out.
5. A comparison first estimates similarity from the union of both short sketches and drops pairs far below the
   threshold, then counts the intersection of both full sets.

For pairs whose union fits into long_k shingles, steps 3 and 4 miss no link; where a bound is on a sample (step 2, the
estimate, larger unions), it lies ``tails`` standard deviations from the mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace, as_bytes, bounded, narrow, released
from lumenfold.llm.components import connected_components
from lumenfold.llm.wordhash import shingle_sets


@dataclass(frozen=True)
class Settings:
    """``percent``: link two sets if 100 * |A & B| >= percent * |A | B|. ``tails``: standard deviations of slack."""

    percent: int = 85
    words: int = 5
    k: int = 64
    long_k: int = 1024
    tails: float = 6.4
    filter_bits: int = 24


def overlap_for(s: Settings, k: int) -> int:
    """Values that two sketches of k share at least, if their sets are similar enough: the mean less ``tails`` deviations."""
    t = s.percent / 100
    return max(1, int(k * t - s.tails * (k * t * (1 - t)) ** 0.5))


def _need(n: Column, s: Settings, k: int) -> Column:
    """Values of its sketch that a set of n shares at least with any set's sketch, if the sets are similar enough.

    Exact where all of any such union fits a sketch (it has at most n * 100 / percent values); else the k smallest of
    the union may be a sample, of which either sketch holds its part.
    """
    whole = F.ceil(n * s.percent / 100)
    return F.when(n * 100 > s.percent * k, F.least(whole, F.lit(overlap_for(s, k)))).otherwise(whole).cast("int")


def _prints(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for a whole set."""
    return [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]


def _signatures(source: DataFrame, s: Settings) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            sets = shingle_sets(as_bytes(batch.column("text")), s.words)
            columns = [batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(_prints(sets), pa.binary()), pa.array([x[: s.k] for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "print", "sketch"])

    return source.mapInArrow(released(run), f"id {kind}, n bigint, print binary, sketch array<bigint>")


def _slot(c: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - bits)


def _full_sets(source: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(id, set) of the wanted ids. A bitmap of fixed size keeps most other texts from being hashed or moved."""
    kind, bits = source.schema["id"].dataType.simpleString(), s.filter_bits
    words = wanted.select(_slot(F.col("id"), bits).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            slots = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((shared.value[slots >> 6] >> (slots & 63)) & 1 == 1))
            if batch.num_rows:
                sets = shingle_sets(as_bytes(batch.column("text")), s.words)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_prints(sets), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "print", "set"])

    found = source.where("id is not null").withColumn("slot", _slot(F.col("id"), bits)).mapInArrow(released(run), f"id {kind}, print binary, set array<bigint>")
    return found.join(wanted, ["id", "print"], "left_semi").dropDuplicates(["id", "print"])


def _lists(sets: DataFrame, s: Settings) -> DataFrame:
    """(v, id, n, central, place) of the values that a class lists; place: how many of its values come before.

    Values come in order of how many classes retain them, then of the value; those that no other class retains come
    first and are only counted. central: how often a class's values are retained in all.
    """
    kept = sets.select("id", "print", F.size("set").alias("n"), F.explode(F.slice("set", 1, s.long_k)).alias("v"))
    shared = kept.join(kept.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "v")
    held = shared.groupBy("id", "print", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    alone = F.least("n", F.lit(s.long_k)) - F.size("held")
    counted = held.withColumn("alone", alone).withColumn("listed", F.size("held") - _need(F.col("n"), s, s.long_k) + 1).where("listed > 0")
    central = F.aggregate("held", F.lit(0).cast("bigint"), lambda t, x: t + x["df"])
    return counted.select("id", "n", central.alias("central"), "alone", F.posexplode(F.expr("slice(held.v, 1, listed)")).alias("at", "v")).select("v", "id", "n", "central", (F.col("alone") + F.col("at")).alias("place"))


def _sized(s: Settings) -> Column:
    """Whether both sets' sizes allow the similarity."""
    return F.expr(f"100 * least(an, bn) >= {s.percent} * greatest(an, bn)")


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets are similar enough."""
    side = lambda df, name, **cols: df.select(F.col("id").alias(name), *[F.col(c).alias(x) for x, c in cols.items()])
    both = pairs.join(side(sketches, "a", at="sketch", an="n"), "a").join(side(sketches, "b", bt="sketch", bn="n"), "b")
    union = F.slice(F.array_sort(F.array_union("at", "bt")), 1, s.k)
    shared = F.size(F.array_intersect(F.array_intersect("at", "bt"), union))
    t = s.percent / 100
    least = t - s.tails * (t * (1 - t) / s.k) ** 0.5
    # the k smallest of the union, or all of a smaller one, are a uniform sample of the sets' union
    likely = both.where(_sized(s)).where(shared >= F.size(union) * F.lit(least)).select("a", "b")
    full = likely.join(side(sets, "b", bs="set"), "b").join(side(sets, "a", **{"as": "set"}), "a")
    common = F.size(F.array_intersect("as", "bs"))
    return full.where(100 * common >= s.percent * (F.size("as") + F.size("bs") - common)).select("a", "b")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id).

    Words are runs of bytes other than space and \\x09-\\x0D with A-Z lower-cased; a text with fewer words than a
    shingle has all of them as one. Null, empty and blank texts have no shingles and are linked with nothing. A null
    id has no component (null) and kept null, and links nothing. Repeated rows are returned each, with one id and
    so one component. Further columns are not read; an empty table gives an empty result.
    """
    s, space = settings, Workspace(df.sparkSession, "neardup")
    source = narrow(df, id=id_col, text=text_col)
    signatures = space.save(_signatures(source, s), "signatures")
    named = signatures.where("n > 0 and id is not null")
    classes = space.save(named.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    values = classes.select("id", "print", "n", F.explode("sketch").alias("v"))
    frequent = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    wanted = values.join(frequent, "v", "left_semi").groupBy("id", "print", "n").count().where(F.col("count") >= _need(F.col("n"), s, s.k))
    wanted = space.save(wanted.select("id", "print"), "wanted")
    sets = space.save(_full_sets(source, wanted, s), "sets")
    lists = space.save(_lists(sets, s), "lists")
    sketches = classes.join(wanted, ["id", "print"], "left_semi").select("id", "n", "sketch")

    links, roots = None, None
    for i in range(2):
        open_lists = lists if roots is None else lists.join(roots.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("root", F.coalesce("root", "id"))
        if roots is None:
            pairs = _star(open_lists, s)
        else:
            split = open_lists.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("v")
            open_lists = open_lists.join(split, "v", "left_semi")
            pairs = _across(open_lists, s)
        found = space.save(_verified(pairs, sketches, sets, s), f"links-{i}")
        links = found if links is None else links.unionByName(found)
        roots = connected_components(links, space, f"roots-{i}")
    ids = classes.select("print", "id").join(roots.withColumnsRenamed({"node": "id"}), "id", "left").select("print", F.coalesce("root", "id").alias("component_id"))
    out = signatures.select("id", "n", F.when(F.col("n") > 0, F.col("print")).alias("print")).join(ids, "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _paired(pairs: DataFrame, s: Settings) -> DataFrame:
    return pairs.where(_sized(s)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(lists: DataFrame, s: Settings) -> DataFrame:
    """Each list's members with its most central one."""
    hubs = lists.groupBy("v").agg(F.max(F.struct("central", "id", "n")).alias("hub")).select("v", F.col("hub.id").alias("a"), F.col("hub.n").alias("an"))
    return _paired(lists.withColumnsRenamed({"id": "b", "n": "bn"}).join(hubs, "v").where("a <> b"), s)


def _across(lists: DataFrame, s: Settings) -> DataFrame:
    """Pairs of a list whose components differ and whose first common value may stand at their places."""
    left = lists.select("v", F.col("id").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"), F.col("place").alias("ap"))
    right = lists.select("v", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"), F.col("place").alias("bp"))
    k, both = s.long_k, 100 + s.percent
    # of n values, those from the first common one on must hold the whole overlap
    overlap = f"if(greatest(an, bn) > {k}, {overlap_for(s, k)}, cast(ceil({s.percent} * (an + bn) / {both}) as int))"
    placed = F.expr(f"ap <= least(an, {k}) - {overlap} and bp <= least(bn, {k}) - {overlap}")
    on = (left["v"] == right["v"]) & (left["a"] < right["b"]) & (left["ar"] != right["br"]) & _sized(s) & placed
    return left.join(right, on).select("a", "b").distinct()
