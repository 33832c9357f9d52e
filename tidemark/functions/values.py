"""Coercions, names, dates, bins and shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Text with a decimal point or comma as a double; null for anything else, NaN too."""
    x = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def flag(c: Column) -> Column:
    """true, 1, yes and y in any case; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def timestamp(c: Column, formats: tuple[str, ...] = ("dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")) -> Column:
    """The first format that fits; null when none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def loose_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy as the first day meant."""
    t = F.trim(c)
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    return F.try_to_date(whole, "yyyy-MM-dd")


#: Letters with marks and their plain forms, for names.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


#: Letters that plain ones stand for in writing.
LETTERS = {"ø": "o", "æ": "ae", "ß": "ss", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}


def plain_letters(c: Column) -> Column:
    """Lower case, marks off, other Latin letters as they are commonly written without them."""
    out = F.translate(F.lower(F.trim(c)), MARKED, PLAIN)
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normal_name(c: Column) -> Column:
    """A name for joining: lower case, marks off, only letters and digits."""
    return F.regexp_replace(plain_letters(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    """A name for paths: runs of anything but letters and digits become one underscore."""
    return F.regexp_replace(F.regexp_replace(plain_letters(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def share(part: Column, whole: Column) -> Column:
    """part / whole; null when whole is null or not positive."""
    return F.when(whole > 0, part / whole)


def midpoint(start: Column, end: Column) -> Column:
    return F.timestamp_micros(F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long"))


def minutes(start: Column, end: Column, fallback: Column | None = None) -> Column:
    """Minutes from start to end, else the fallback."""
    own = (F.unix_micros(end) - F.unix_micros(start)) / 60e6
    return own if fallback is None else F.coalesce(own, fallback)


def left_closed_bin(c: Column, width: float) -> Column:
    """Left edge of the bin [left, left + width)."""
    return F.floor(c / width) * width


def right_closed_bin(c: Column, width: float) -> Column:
    """Left edge of the bin (left, left + width]."""
    return (F.ceil(c / width) - 1) * width


def edges_bin(c: Column, edges: list[float], right: bool = False) -> Column:
    """Label left-right of the bin among edges; null outside them. Bins are left-closed unless right."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        inside = (c > a) & (c <= b) if right else (c >= a) & (c < b)
        out = F.when(inside, F.lit(f"{a:g}-{b:g}")).otherwise(out)
    return out


def cache_key(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def file_fields(path: Column) -> tuple[Column, Column, Column, Column]:
    """lat, lon, year and month of names like site_54.01_6.53_2024_03.csv."""
    at = lambda i: F.nullif(F.regexp_extract(path, r"_(-?\d+\.\d+)_(-?\d+\.\d+)_(\d{4})_(\d{2})\.", i), F.lit(""))
    return at(1).cast("double"), at(2).cast("double"), at(3).cast("int"), at(4).cast("int")


def lag_text(hours: Column) -> Column:
    """Hours as years, days and hours."""
    h = F.abs(hours)
    text = F.concat(F.floor(h / 8760).cast("string"), F.lit("y "), F.floor((h % 8760) / 24).cast("string"), F.lit("d "), (h % 24).cast("string"), F.lit("h"))
    return F.when(hours < 0, F.concat(F.lit("-"), text)).otherwise(text)


def reasons(*tests: tuple[Column, str]) -> Column:
    """Texts of the tests that hold, in order, joined by '; '."""
    return F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(s)) for t, s in tests))), "; ")
