"""String, path and date functions as Column expressions; all run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how UUIDs are written.
UUID = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def non_empty(c: Column) -> Column:
    """Empty text as null."""
    return F.nullif(c, F.lit(""))


def norm_id(c: Column) -> Column:
    """Ids as they are compared: trimmed, lower case, null as empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def extract_uuid(c: Column) -> Column:
    """First UUID in a file name, lower case, or null."""
    return non_empty(F.lower(F.regexp_extract(c, UUID, 0)))


def id_before_underscore(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(1))


def video_slug(video_id: Column, title: Column, words: int = 5, width: int = 40) -> Column:
    """The id, an underscore, and the first words of a title joined by dashes: symbols part words, single characters go."""
    plain = F.filter(F.split(F.regexp_replace(title, "[^A-Za-z0-9]", " "), " +"), lambda w: w != "")
    kept = F.filter(F.slice(plain, 1, words), lambda w: F.length(w) > 1)
    return F.concat(video_id.cast("string"), F.lit("_"), F.left(F.lower(F.array_join(kept, "-")), F.lit(width)))


def round_half_even(c: Column, places: int) -> Column:
    """Decimals cut to ``places``, halves to the even digit, as a double."""
    return F.bround(c.cast("decimal(28,12)"), places).cast("double")


def name_slug(name: Column) -> Column:
    """A name for URLs: punctuation dropped, everything else than letters and digits a single dash."""
    plain = F.regexp_replace(F.lower(name), "['\",.!?:]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def channel_name(url: Column) -> Column:
    """The @handle of a channel URL, else its last path segment."""
    return F.coalesce(non_empty(F.regexp_extract(url, "@([^/?#]+)", 1)), F.substring_index(F.rtrim(url, F.lit("/")), "/", -1))


def tokens(c: Column) -> Column:
    """Lower-case tokens of a list that commas or blanks part."""
    return F.filter(F.split(F.lower(F.trim(c)), r"[\s,]+"), lambda x: x != "")


def strip_fences(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", "")


def url_extension(url: Column) -> Column:
    path = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    return non_empty(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def url_epoch(url: Column) -> Column:
    """The number after the question mark, or null."""
    return F.split_part(url, F.lit("?"), F.lit(2)).try_cast("bigint")


def sharded_path(root: str, c: Column, extension: str) -> Column:
    """root / first character / second character / id.extension, x for a missing character."""
    part = lambda i: F.coalesce(non_empty(F.substring(c, i, 1)), F.lit("x"))
    return F.concat_ws("/", F.lit(root), part(1), part(2), F.concat(c, F.lit(f".{extension}")))


def card_label(name: Column, set_code: Column, set_name: Column) -> Column:
    unknown = F.lit("Unknown")
    return F.format_string("%s [%s] (%s)", F.coalesce(non_empty(name), unknown), F.upper(F.coalesce(non_empty(set_code), F.lit("?"))), F.coalesce(non_empty(set_name), unknown))


def remap_path(path: Column, prefixes: list[tuple[str, str]], suffix: str) -> Column:
    """The first prefix that fits replaced, and the extension swapped."""
    out = F.lit(None).cast("string")
    for old, new in reversed(prefixes):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(out)
    return F.regexp_replace(F.coalesce(out, path), r"\.[^./]+$", suffix)


def cache_key(codes: Column, lang: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(codes), "_"), F.lit("_"), lang)


def zero_pad(n: Column, width: int = 4) -> Column:
    """Zero-padded number, empty for 0 or null."""
    return F.when(F.coalesce(n, F.lit(0)) != 0, F.format_string(f"%0{width}d", n)).otherwise("")


def csv_escape(c: Column) -> Column:
    """Quoted if it holds a quote, comma or line break, quotes doubled."""
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def md_escape(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = seconds.cast("bigint")
    h, m, rest = (s / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def parse_price(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    """True or false from common spellings, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes"), True).when(low.isin("0", "false", "no"), False)


def file_epoch(c: Column) -> Column:
    return F.regexp_extract(c, r"_e(\d+)_(\d+)d", 1).try_cast("int")


def file_dim(c: Column) -> Column:
    return F.regexp_extract(c, r"_e(\d+)_(\d+)d", 2).try_cast("int")


def key_value(c: Column) -> tuple[Column, Column]:
    """Both sides of name=value; the name is null without an equals sign."""
    has = c.contains("=")
    return F.when(has, F.substring_index(c, "=", 1)), F.when(has, F.substr(c, F.instr(c, "=") + 1))


def newer_than(iso: Column, other: Column) -> Column:
    return F.to_timestamp(iso) > other
