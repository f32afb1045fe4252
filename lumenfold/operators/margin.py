"""Softmax loss with an additive angular margin, over classes in blocks: no row and no task ever holds all classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    margin: float = 0.3
    scale: float = 30.0
    classes: int = 2048
    rows: int = 4096


def with_margin(cosine: Column, margin: float) -> Column:
    """cos(angle + margin); where that would turn back, behind pi - margin, cosine less a constant, so that it keeps falling."""
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - cosine * cosine))
    return F.when(cosine > math.cos(math.pi - margin), cosine * math.cos(margin) - sine * math.sin(margin)).otherwise(cosine - math.sin(math.pi - margin) * margin)


def _unit(column: pa.Array) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def margin_loss(vectors: DataFrame, classes: DataFrame, *, id_col: str, label_col: str, vector_col: str, class_col: str, weight_col: str, settings: Settings = Settings()) -> DataFrame:
    """id, label, cosine (with the own class), logit (with the margin, scaled), loss: a row for every different id.

    Both sides are brought to length one. Class and vector blocks meet all to all, as a softmax asks for; a meeting
    sends a row's sum of exponentials and no logits. As no logit exceeds ``scale``, exponentials are taken of the logit
    less ``scale``: sums of blocks just add up, and 2 * scale under 700 loses nothing to underflow. Rows whose vector or
    label is null, or whose label isn't a class, are left out, as are classes that are null or come twice (the smallest weight
    stays). Ids are unique; of repeated ids one row is kept, the smallest.
    """
    s = settings
    known = classes.select(F.col(class_col).alias("class"), F.col(weight_col).cast("array<double>").alias("w")).where("class is not null and w is not null")
    known = known.groupBy("class").agg(F.min("w").alias("w"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    own = rows.join(known.select(F.col("class").alias("label"), F.col("w")), "label")
    n_classes, n_rows = known.count(), rows.count()
    blocks, parts = max(1, -(-n_classes // s.classes)), max(1, -(-n_rows // s.rows))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.select("id", "v", cut("id", parts).alias("part"), every(blocks).alias("block"))
    right = known.select("w", cut("class", blocks).alias("block"), every(parts).alias("part"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    length = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-12))
    own = own.select("id", "label", (dot / (length("v") * length("w"))).alias("cosine"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": a["id"].slice(0, 0), "powers": pa.array([], pa.float64())})
        return pa.table({"id": a["id"], "powers": np.exp(s.scale * (_unit(a["v"]) @ _unit(b["w"]).T) - s.scale).sum(axis=1)})

    kind = rows.schema["id"].dataType.simpleString()
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, f"id {kind}, powers double")
    total = met.groupBy("id").agg(F.sum("powers").alias("powers"))
    logit = s.scale * with_margin(F.col("cosine"), s.margin)
    # the own class takes part with its margin in place of its plain cosine
    powers = F.greatest(F.col("powers") - F.exp(s.scale * F.col("cosine") - s.scale), F.lit(0.0)) + F.exp(F.col("logit") - s.scale)
    out = own.withColumn("logit", logit).join(total, "id").withColumn("loss", s.scale + F.log(powers) - F.col("logit"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "cosine", "logit", "loss")
