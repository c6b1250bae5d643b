"""Scalar functions over company fields: headcount, country, funding, dates, numbers for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_list, clean, missing_if_empty, strip

#: The registry's headcount buckets, in order.
HEADCOUNT = (
    "c_00001_00010", "c_00011_00050", "c_00051_00100", "c_00101_00250", "c_00251_00500",
    "c_00501_01000", "c_01001_05000", "c_05001_10000", "c_10001_max",
)
#: Upper ends of buckets 1 to 7 for a plain team size; below 10 is bucket 0, so 10 itself is in bucket 1.
_UPPER = (50, 100, 250, 500, 1000, 5000, 10000)


def team_size_bucket(n: Column) -> Column:
    out = F.when(n < 10, 0)
    for i, most in enumerate(_UPPER, 1):
        out = out.when(n <= most, i)
    return F.when(n.isNotNull(), out.otherwise(8))


def enum_bucket(c: Column) -> Column:
    """Index of a headcount bucket's name; null for an unknown name."""
    i = F.array_position(F.lit(list(HEADCOUNT)), c)
    return F.when(i > 0, (i - 1).cast("int"))


def headcount_bucket(enum: Column, team_size: Column) -> Column:
    """The enum decides if there is one, even an unknown one; else the team size."""
    return F.when(missing_if_empty(enum).isNotNull(), enum_bucket(enum)).otherwise(team_size_bucket(team_size))


def parse_funding(c: Column) -> Column:
    """Digits, dots and minus signs as a number; anything else around them is dropped, so "$1.5M" is 1.5."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


#: Date formats that are tried, in order; the reference's lenient parser knows more.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM", "yyyy")


def parse_founded(c: Column) -> tuple[Column, Column]:
    """(date, year) of a founding date, or nulls."""
    s = clean(c)
    date = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    return date, F.year(date)


def founded_from_epoch(c: Column) -> tuple[Column, Column]:
    """(date, year) of a positive number of seconds since 1970, within the years that a date can show."""
    date = F.when((c > 0) & (c < 253402300800), F.timestamp_seconds(c)).cast("date")
    return date, F.year(date)


def registry_country(locations: Column) -> Column:
    """The third location of three or more, else the last."""
    return F.when(F.size(locations) >= 3, F.get(locations, F.lit(2))).otherwise(F.try_element_at(locations, F.lit(-1)))


def directory_country(all_locations: Column, regions: Column) -> Column:
    """The last comma-separated part of the locations, else the first region."""
    last = missing_if_empty(strip(F.try_element_at(F.split(all_locations, ","), F.lit(-1))))
    return F.coalesce(last, F.get(as_list(regions), F.lit(0)))


def safe_div(num: Column, den: Column) -> Column:
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), 4)


def match_method(domain: Column, name: Column) -> Column:
    return F.when(domain & name, "both").when(domain, "domain").otherwise("name+year")


#: Fixed value: how a missing number is shown.
NO_NUMBER = "—"


def _fixed(x: Column, digits: int) -> Column:
    """x with so many digits (three at most), rounded as the binary value that it is, a tie away from zero."""
    tie = F.when(x * 16 == F.floor(x * 16), F.signum(x) * 1e-9).otherwise(0.0)
    return F.translate(F.format_number(x + tie, digits), ",", "")


def display_number(n: Column) -> Column:
    """1200 as 1.2K, 2000 as 2K, 12345 as 12K, 1250000 as 1.3M; a missing number as a dash."""

    def shown(x: Column, unit: str) -> Column:
        return F.concat(F.regexp_replace(_fixed(x, 1), r"\.0$", ""), F.lit(unit))

    return (
        F.when(n.isNull(), F.lit(NO_NUMBER))
        .when(n >= 1_000_000, shown(n / 1_000_000, "M"))
        .when(n >= 10_000, F.concat(F.round(n / 1_000).cast("long").cast("string"), F.lit("K")))
        .when(n >= 1_000, shown(n / 1_000, "K"))
        .otherwise(n.cast("string"))
    )


def display_cosine(c: Column) -> Column:
    """Three digits; a missing similarity as a dash."""
    return F.coalesce(_fixed(c.cast("double"), 3), F.lit(NO_NUMBER))


def site_url(domain: Column) -> Column:
    """A link to a domain, whatever scheme it has; null without a domain."""
    return F.when(domain != "", F.concat(F.lit("https://"), F.regexp_replace(domain, "^https?://", "")))


def criterion_class(criterion_id: Column) -> Column:
    """The display class of a criterion: seven of them, in turn."""
    return F.concat(F.lit("c"), (F.pmod(criterion_id - 1, F.lit(7)) + 1).cast("string"))


def initials(name: Column) -> Column:
    """First letters of the first two words, upper case; a question mark without any."""
    words = F.slice(F.filter(F.split(name, r"\s+"), lambda w: w != ""), 1, 2)
    made = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit("?")).otherwise(made)
