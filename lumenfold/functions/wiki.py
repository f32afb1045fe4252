"""Tables of wiki pages as Column expressions: tick matrices, and rows of one entry each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.binding import let

# What opens and closes the template that names a card, the mark of a ticked cell, and what ends a set's code.
OPEN, CLOSE, TICK, AFTER_CODE = "{{card|", "}}", "{{cell|tick}}", "<br>"
ROW = r"(?m)^\|-.*$"


def _rows(page: Column) -> Column:
    """Each row's lines."""
    return F.transform(F.split(page, ROW), lambda row: F.split(row, r"\r?\n"))


def _named(line: Column) -> Column:
    """The first parameter of a line's first card template; empty without one, or if it isn't closed or holds another."""

    def closed(inner: Column) -> Column:
        name = F.substring_index(F.substring_index(inner, CLOSE, 1), "|", 1)
        return F.when(inner.contains(CLOSE) & ~name.contains("{"), F.trim(name)).otherwise("")

    return F.when(line.contains(OPEN), let(F.get(F.split(line, r"\Q" + OPEN + r"\E", 2), F.lit(1)), closed)).otherwise("")


def _card(lines: Column) -> Column:
    """The name in the first card template, or null."""
    return F.get(F.filter(F.transform(lines, _named), lambda name: name != ""), F.lit(0))


def _codes(page: Column) -> Column:
    """The sets' codes that a page's header cells begin with, in order."""
    cells = F.filter(F.split(page, r"\r?\n"), lambda line: line.startswith("!") & line.contains(AFTER_CODE))
    codes = F.transform(cells, lambda line: F.substring_index(F.substr(line, F.lit(2)), AFTER_CODE, 1))
    return F.filter(codes, lambda code: code.rlike("^[A-Z0-9]+$"))


def _ticks(lines: Column, heads: Column, first: Column, card: Column) -> Column:
    later = F.filter(lines, lambda line, i: (i >= first) & (line.startswith("|") | line.contains(TICK)))
    cells = F.flatten(F.transform(later, lambda line: F.when(line.startswith("|"), F.split(F.substr(line, F.lit(2)), r"\|\|")).otherwise(F.array(line))))
    marks = F.transform(cells, lambda cell, i: F.struct(F.lower(F.get(heads, i)).alias("host_set"), card.alias("name"), cell.contains(TICK).alias("tick")))
    kept = F.filter(marks, lambda m: m["tick"] & m["host_set"].isNotNull() & m["name"].isNotNull())
    return F.transform(kept, lambda m: F.struct(m["host_set"].alias("host_set"), m["name"].alias("name")))


def _ticked(heads: Column):
    def of(lines: Column) -> Column:
        """(host_set, name) of a row's ticks: columns are counted from the first cell after the one with the card."""
        first = F.array_position(F.transform(lines, lambda line: line.startswith("|") & line.contains(OPEN)), F.lit(True)).cast("int")
        return let(F.struct(first.alias("first"), _card(lines).alias("card")), lambda of: F.when(of["first"] > 0, _ticks(lines, heads, of["first"], of["card"])))

    return of


def tick_matrix(page: Column) -> Column:
    """(host_set, name) for each tick of a page whose header cells name the sets; a row has fixed cells, its card, then ticks.

    A cell is what stands between bars of a line that begins with one; a ticked line without a bar is a cell as well.
    """
    return let(_codes(page), lambda heads: F.flatten(F.filter(F.transform(_rows(page), _ticked(heads)), lambda found: found.isNotNull())))


def _entry(lines: Column) -> Column:
    cells = F.transform(F.filter(lines, lambda line: line.startswith("|")), lambda line: F.trim(F.substr(line, F.lit(2))))
    host = F.lower(F.get(cells, F.lit(0)))
    name = _card(cells)
    return F.when((F.size(cells) >= 2) & host.rlike("^[a-z0-9]+$") & name.isNotNull(), F.struct(host.alias("host_set"), name.alias("name")))


def row_entries(page: Column) -> Column:
    """(host_set, name) of each row of two cells or more whose first is a set's code and one of which names a card."""
    return F.filter(F.transform(_rows(page), _entry), lambda entry: entry.isNotNull())
