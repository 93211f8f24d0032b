"""Date parsing from mixed text, and the parts taken from a timestamp.

Every accepted shape is rewritten to ISO order by one ``regexp_replace`` and then cast, so a
bad value costs a null, not an exception, and the expression stays small enough to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = r"((?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)"
ZONE = r"(Z|[+-]\d{2}:?\d{2})"
ISO_SHAPE = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + CLOCK + ZONE + "?$"
NUMERIC_SHAPE = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + CLOCK + ZONE + "?$"
DAY_NAME_SHAPE = r"^(\d{1,2})[ -]([A-Za-z]{3,9})(?:[ -]|, ?)(\d{4})" + CLOCK + ZONE + "?$"
NAME_DAY_SHAPE = r"^([A-Za-z]{3,9})[ -](\d{1,2})(?:,? +|-)(\d{4})" + CLOCK + ZONE + "?$"

# A half of the day, a zone's name, an offset behind a blank or without seconds before it, a long fraction.
WORDY_CLOCK = r"(?i)\d ?[a-z. ]+([+-]\d{2}:?\d{2})?$|\d [+-]\d{2}:?\d{2}$|[ T]\d{1,2}:\d{2}" + ZONE + r"$|\.\d{7}"

# Month names by number; the first three letters or the whole word may stand.
MONTHS = ["jan(uary)?", "feb(ruary)?", "mar(ch)?", "apr(il)?", "may", "june?", "july?", "aug(ust)?",
          "sep(t|tember)?", "oct(ober)?", "nov(ember)?", "dec(ember)?"]
# Zone names a clock may end in, with their offsets.
ZONES = {"UTC": "Z", "GMT": "Z", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "CET": "+01:00", "CEST": "+02:00"}
ORDERS = ["ymd", "dmy", "mdy", "ydm"]


def _with_century(c: Column) -> Column:
    """Two-digit years of a numeric date: 69 and later are 19xx, earlier ones 20xx."""
    head = r"^(\d{1,2}[-/.]\d{1,2}[-/.])"
    old = F.regexp_replace(c, head + r"(69|[7-9]\d)( .*|T.*)?$", "$119$2$3")
    return F.regexp_replace(old, head + r"([0-6]\d)( .*|T.*)?$", "$120$2$3")


def _month_words(c: Column) -> Column:
    for number, word in enumerate(MONTHS, 1):
        c = F.regexp_replace(c, f"(?i)-{word}-", f"-{number}-")
    return c


def plain_clock(c: Column) -> Column:
    """Twelve-hour clocks as 24-hour ones, fractions cut to microseconds, zone names as offsets; other text as it is.

    A clock stands behind a date after blanks or a T: ``3 PM``, ``3:30 pm``, ``03:30:15.123456789 P.M.``, each with or without a zone.
    """
    c = F.regexp_replace(c, r"(:\d{2}\.\d{6})\d+", "$1")
    for name, offset in ZONES.items():
        c = F.regexp_replace(c, rf"(?i)(\d|[ap]\.?m\.?) ?{name}$", f"$1{offset}")
    c = F.regexp_replace(c, r"(?i)(\d|[ap]\.?m\.?) " + ZONE + "$", "$1$2")
    c = F.regexp_replace(c, r"(?i)([ T]\d{1,2})( ?[ap]\.?m\.?" + ZONE + "?)$", "$1:00$2")
    for hour in range(1, 13):
        for half, day_hour in (("a", hour % 12), ("p", hour % 12 + 12)):
            c = F.regexp_replace(c, rf"(?i)[ T]+0?{hour}(:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?) ?{half}\.?m\.?" + ZONE + "?$", f" {day_hour:02d}$1$2")
    return F.regexp_replace(c, r"([ T]\d{1,2}:\d{2})" + ZONE + "$", "$1:00$2")


def _with_plain_clock(c: Column, parse) -> Column:
    """``parse`` on the text, or where its clock has words or a long fraction, on the text with a plain clock, which is built once."""
    once = F.get(F.transform(F.array(plain_clock(c)), parse), F.lit(0))
    return F.when(c.rlike(WORDY_CLOCK), once).otherwise(parse(c))


def _offset(c: Column) -> Column:
    return F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")


def date_in_order(c: Column, order: str) -> Column:
    """Timestamp from text whose date has its parts in one order (``ORDERS``), with any separator and clock; null for other text."""
    part = {"y": r"(\d{4})", "m": r"(\d{1,2})", "d": r"(\d{1,2})"}
    shape = r"^" + r"[-/. ]".join(part[p] for p in order) + CLOCK + ZONE + "?$"
    at = {p: f"${i}" for i, p in enumerate(order, 1)}

    def parse(text: Column) -> Column:
        text = _with_century(text) if order[0] != "y" else text
        return F.when(text.rlike(shape), _offset(F.regexp_replace(text, shape, f"{at['y']}-{at['m']}-{at['d']}$4$5")).try_cast("timestamp"))

    return _with_plain_clock(c, parse)


def vote_orders(values: DataFrame, dayfirst: bool = False) -> dict[str, str]:
    """The date order most rows of each column are written in, from (column, value, n); orders that read equally many rows go to the default.

    Columns without any date in digits are left out.
    """
    first = "dmy" if dayfirst else "mdy"
    ranked = ["ymd", first, *[o for o in ORDERS if o not in ("ymd", first)]]
    read = [F.sum(F.when(date_in_order(F.col("value"), o).isNotNull(), F.col("n"))).alias(o) for o in ranked]
    rows = values.groupBy("column").agg(*read).collect()  # a row per column
    votes = {r["column"]: max(ranked, key=lambda o: (r[o] or 0, -ranked.index(o))) for r in rows}
    return {r["column"]: votes[r["column"]] for r in rows if r[votes[r["column"]]]}


def parse_date(c: Column, dayfirst: bool = False, order: str | None = None) -> Column:
    """Timestamp from ISO, numeric and month-name dates, each with an optional clock.

    Numeric dates are read day first or month first as asked, and in the other order when that fails. Bare digits are never
    dates, and ISO text is never flipped. ``order``, which ``vote_orders`` finds for a whole column, is tried before all others.
    Clocks may have twelve hours with AM or PM, nine digits of a second, and an offset or the name of a zone.
    """
    if order is not None:
        return F.coalesce(date_in_order(c, order), parse_date(c, dayfirst))

    def parse(c: Column) -> Column:
        iso = _offset(F.regexp_replace(c, r"^(\d{4})[/.](\d{1,2})[/.]", "$1-$2-"))
        long_year = _with_century(c)
        day_month = _offset(F.regexp_replace(long_year, NUMERIC_SHAPE, "$3-$2-$1$4$5")).try_cast("timestamp")
        month_day = _offset(F.regexp_replace(long_year, NUMERIC_SHAPE, "$3-$1-$2$4$5")).try_cast("timestamp")
        numeric = F.coalesce(day_month, month_day) if dayfirst else F.coalesce(month_day, day_month)
        return (
            F.when(c.rlike(ISO_SHAPE), iso.try_cast("timestamp"))
            .when(c.rlike(NUMERIC_SHAPE), numeric)
            .when(c.rlike(DAY_NAME_SHAPE), _month_words(_offset(F.regexp_replace(c, DAY_NAME_SHAPE, "$3-$2-$1$4$5"))).try_cast("timestamp"))
            .when(c.rlike(NAME_DAY_SHAPE), _month_words(_offset(F.regexp_replace(c, NAME_DAY_SHAPE, "$3-$1-$2$4$5"))).try_cast("timestamp"))
        )

    return _with_plain_clock(c, parse)


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def date_parts(ts: Column) -> dict[str, Column]:
    """Calendar and clock parts as doubles; Monday is weekday 0."""
    return {
        "year": F.year(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "day": F.day(ts).cast("double"),
        "weekday": F.weekday(ts).cast("double"),
        "hour": F.hour(ts).cast("double"),
        "minute": F.minute(ts).cast("double"),
    }


def expand_datetime(df: DataFrame, column: str, style: str = "clean") -> DataFrame:
    """Replace a timestamp column by its parts.

    ``clean`` names them ``<c>__year`` to ``<c>__minute``; ``upload`` names them
    ``<c>_day`` to ``<c>_minute`` and leaves the year out.
    """
    parts = date_parts(F.col(f"`{column}`"))
    if style == "upload":
        new = {f"{column}_{p}": e.cast("int") for p, e in parts.items() if p != "year"}
    else:
        new = {f"{column}__{p}": e for p, e in parts.items()}
    return df.withColumns(new).drop(column)
