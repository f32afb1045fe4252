"""The first places of every group, with the sizes of their ties, by an external merge tree.

1. Runs: each task sorts its rows in Arrow, some hundred thousand at a time, keeps a group's first ``k`` lines of the run
   and counts, for the pair of each, how many of the run's lines have it. No later line and no other pair can matter:
   a pair behind the run's k-th line is behind the k-th line of the whole group too. The run is cut at the borders of
   ranges of a hash of the group, which are the same for every run, and written to the shared folder.
2. Merges: a task holds one range of at most about ``fan`` runs and merges them by a heap of the runs' heads. In each group
   it stops as soon as ``k`` lines have their places, looks ahead at the other heads for the last place's pair, so
   that every tie is counted to its end, and moves all runs on to their next group.
3. Merged ranges are runs themselves: with more than ``fan`` runs, buckets of runs are merged first, then their results, with
   finer ranges at every level. A task's share stays near ``run_rows`` at any size, and a group that holds a third of all
   lines, or all, sends ``k`` lines a run into a merge.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Workspace, released

NULL = np.iinfo(np.int64).max  # stands for null in keys, behind all values
SLICES = "range bigint, run bigint, data binary"


@dataclass(frozen=True)
class Settings:
    run_rows: int = 1 << 18
    fan: int = 64


def _key(c: Column, descending: bool = False) -> Column:
    whole = c.cast("bigint")
    return F.coalesce(-whole if descending else whole, F.lit(int(NULL)))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _changes(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first_places(table: pa.Table, groups: int, pair: int, k: int) -> pa.Table:
    """The first k lines of each group of a sorted table, with ``tied``: lines of the table with the same group and pair."""
    columns = [c.to_numpy() for c in table.columns]
    new_group, new_pair = _changes(columns[: 1 + groups]), _changes(columns[: 1 + groups + pair])
    starts = np.flatnonzero(new_group)
    place = np.arange(len(new_group)) - np.repeat(starts, np.diff(np.append(starts, len(new_group))))
    ties = np.diff(np.append(np.flatnonzero(new_pair), len(new_pair)))
    kept = np.flatnonzero(place < k)
    return table.take(pa.array(kept)).append_column("tied", pa.array(np.repeat(ties, ties)[kept]))


def _cut(table: pa.Table, bits: int) -> Iterator[tuple[int, pa.Table]]:
    """The ranges that a sorted table has rows of: by the first ``bits`` bits of the hash."""
    ranges = (table["c0"].to_numpy() >> (64 - bits)) + (1 << bits >> 1) if bits else np.zeros(len(table), np.int64)
    starts = np.flatnonzero(_changes([ranges])) if len(table) else []
    for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
        yield int(ranges[a]), table.slice(a, b - a)


def _merge(slices: list[pa.Table], groups: int, pair: int, k: int) -> tuple[pa.Table, np.ndarray]:
    """The first k lines of each group of sorted slices with the sizes of their ties, and their positions from 1."""
    keyed, nexts = [], []
    for s in slices:
        columns = [c.to_numpy() for c in s.columns[:-1]]
        starts = np.flatnonzero(_changes(columns[: 1 + groups]))
        keyed.append(list(zip(*[c.tolist() for c in columns], strict=True)))
        nexts.append(np.repeat(np.append(starts[1:], len(s)), np.diff(np.append(starts, len(s)))).tolist())
    tied = [s["tied"].to_pylist() for s in slices]
    g, p = 1 + groups, 1 + groups + pair
    heap = [(rows[0], i, 0) for i, rows in enumerate(keyed) if rows]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    ties: list[int] = []
    places: list[int] = []
    while heap:
        group = heap[0][0][:g]
        own, current, count = [], None, 0  # numbers of taken lines with the current pair, the pair, its lines so far
        seen: set[int] = set()  # slices whose lines with the current pair are counted
        place = 0
        while heap and heap[0][0][:g] == group and place < k:
            key, i, at = heap[0]
            if key[:p] != current:
                for n in own:
                    ties[n] = count
                own, current, count, seen = [], key[:p], 0, set()
            if i not in seen:
                seen.add(i)
                count += tied[i][at]
            place += 1
            own.append(len(taken))
            taken.append((i, at))
            ties.append(0)
            places.append(place)
            if at + 1 < len(keyed[i]):
                heapq.heapreplace(heap, (keyed[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        while heap and heap[0][0][:g] == group:  # lookahead: heads with the last pair have lines to count; then on to the next group
            key, i, at = heap[0]
            if key[:p] == current and i not in seen:
                seen.add(i)
                count += tied[i][at]
            after = nexts[i][at]
            if after < len(keyed[i]):
                heapq.heapreplace(heap, (keyed[i][after], i, after))
            else:
                heapq.heappop(heap)
        for n in own:
            ties[n] = count
    base = np.concatenate([[0], np.cumsum([len(s) for s in slices])])
    rows = pa.array(base[np.array([i for i, _ in taken], int)] + np.array([at for _, at in taken], int))
    whole = pa.concat_tables(slices).take(rows)
    return whole.set_column(whole.num_columns - 1, "tied", pa.array(ties, pa.int64())), np.array(places, np.int64)


def first_places(df: DataFrame, groups: dict[str, Column], pair: dict[str, tuple[Column, bool]], then: dict[str, tuple[Column, bool]], k: int, settings: Settings = Settings()) -> DataFrame:
    """The lines of each group with pos 1 to ``k``: the columns of ``groups``, ``pair`` and ``then``, pos, place, tied; all bigint.

    Lines are ordered by ``pair``, then by ``then``; a column is given with whether larger values come first. Nulls
    come last in either direction, are equal to each other, and make a group of their own. Equal lines are counted and
    returned each. place equals pos; tied is the number of all lines of the group with the line's pair, returned or
    not. Values are whole numbers above -2^63 and below 2^63 - 1. Further columns aren't read, so their names can't
    clash; an empty table gives an empty result.
    """
    s, space = settings, Workspace(df.sparkSession, "ranking")
    ordered = [*((c, False) for c in groups.values()), *pair.values(), *then.values()]
    names, backwards = [*groups, *pair, *then], [descending for _, descending in ordered]
    keys = [_key(c, descending).alias(f"c{i}") for i, (c, descending) in enumerate(ordered, 1)]
    rows = df.select(*keys)
    rows = rows.select(F.xxhash64(*[f"c{i}" for i in range(1, len(groups) + 1)]).alias("c0"), "*")
    columns, n_groups, n_pair, fan_bits = rows.columns, len(groups), len(pair), (s.fan - 1).bit_length()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 24)

        def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = _first_places(table.take(pc.sort_indices(table, [(c, "ascending") for c in columns])), n_groups, n_pair, k)
            own = next(number)
            slices = [(r, own, _packed(part)) for r, part in _cut(table, fan_bits)]
            yield _slices(slices)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= s.run_rows:
                yield from run(held)
                held, size = [], 0
        if size:
            yield from run(held)

    runs = space.save(rows.mapInArrow(released(sort), SLICES), "runs-0")
    left, bits = runs.agg(F.count_distinct("run")).first()[0], fan_bits
    for level in itertools.count(1):
        buckets = -(-left // s.fan) or 1
        # ranges finer by the fan at every level, but not finer than there are runs to fill them
        finer = min(bits + fan_bits, 62, max(bits, (left - 1).bit_length()))
        dealt = runs.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)))
        if buckets == 1:
            return _finish(dealt, names, backwards, n_groups, n_pair, k)

        runs = space.save(dealt.groupBy("bucket", "range").applyInArrow(_merged_run(n_groups, n_pair, k, finer), SLICES), f"runs-{level}")
        space.drop(f"runs-{level - 1}")
        left, bits = buckets, finer


def _merged_run(groups: int, pair: int, k: int, bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        merged, _ = _merge([pa.ipc.open_stream(d).read_all() for d in table["data"].to_pylist()], groups, pair, k)
        return pa.Table.from_batches([_slices([(r, key[0].as_py(), _packed(part)) for r, part in _cut(merged, bits)])])

    return merge


def _slices(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["range", "run", "data"])


def _finish(dealt: DataFrame, names: list[str], backwards: list[bool], groups: int, pair: int, k: int) -> DataFrame:
    """The last merge: values as they were given."""

    def merge(table: pa.Table) -> pa.Table:
        merged, places = _merge([pa.ipc.open_stream(d).read_all() for d in table["data"].to_pylist()], groups, pair, k)
        values = []
        for i, descending in enumerate(backwards, 1):
            c = merged[f"c{i}"].to_numpy()
            values.append(pa.array(-c if descending else c, pa.int64(), mask=c == NULL))
        place = pa.array(places)
        return pa.table([*values, place, place, merged["tied"]], names=[f"c{i}" for i in range(len(backwards))] + ["pos", "place", "tied"])

    schema = ", ".join(f"c{i} bigint" for i in range(len(names))) + ", pos bigint, place bigint, tied bigint"
    out = dealt.groupBy("bucket", "range").applyInArrow(merge, schema)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "pos", "place", "tied")
