"""First places of groups against sorting everything, at fans and runs so small that merges have several levels."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.ranking import Settings, first_places

SCHEMA = "g long, h long, p long, q long, a long, b long, pos string"
COLUMNS = lambda: ({"g": F.col("g"), "h": F.col("h")}, {"p": (F.col("p"), True), "q": (F.col("q"), False)}, {"a": (F.col("a"), False), "b": (F.col("b"), True)})


def brute(rows, k):
    last = lambda v, back=False: (v is None, 0 if v is None else -v if back else v)
    group, pair = lambda r: (last(r[0]), last(r[1])), lambda r: (last(r[2], True), last(r[3]))
    out = []
    for _, own in groupby(sorted(rows, key=lambda r: (group(r), pair(r), last(r[4]), last(r[5], True))), key=group):
        own = list(own)
        out += [(*r[:6], n, n, sum(pair(x) == pair(r) for x in own)) for n, r in enumerate(own[:k], 1)]
    return sorted(out, key=str)


def lines(n, seed=5):
    rng = random.Random(seed)
    some = lambda m: None if rng.random() < 0.1 else rng.randrange(-m, m)
    # a third of all lines in one group, and a group of equal lines
    rows = [(*((7, None) if rng.random() < 0.33 else (some(6), some(3))), some(2), some(2), some(3), some(3), "x") for _ in range(n)]
    return [*rows, *[(99, 99, 1, 1, 1, 1, "y")] * 500]


@pytest.mark.parametrize("k, run_rows, fan, parts", [(2, 1 << 18, 64, 4), (2, 16, 2, 5), (3, 7, 4, 3), (50, 64, 4, 2), (1, 1, 2, 1)])
def test_equals_sorting(spark, k, run_rows, fan, parts):
    rows = lines(300 if run_rows == 1 else 3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = first_places(df, *COLUMNS(), k=k, settings=Settings(run_rows=run_rows, fan=fan)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_empty_table(spark):
    got = first_places(spark.createDataFrame([], SCHEMA), *COLUMNS(), k=2)
    assert got.columns == ["g", "h", "p", "q", "a", "b", "pos", "place", "tied"] and got.collect() == []
