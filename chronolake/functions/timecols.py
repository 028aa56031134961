"""Time columns: mixed source strings to timestamps and dates, publication clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(Z|[+-]\d\d:?\d\d)$"
_BLANKS = ("", "nan", "none", "nat")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null, white space, and the words that stand for a missing value."""
    return _col(c).isNull() | F.lower(F.trim(_col(c).cast("string"))).isin(*_BLANKS)


def to_cn_timestamp(c: Column | str) -> Column:
    """The instant of an ISO-like string; without an offset it is a wall clock eight hours ahead of UTC; bad text is null."""
    text = F.regexp_replace(F.trim(_col(c)), r"^(\d{4})(\d\d)(\d\d)([ T])", "$1-$2-$3$4")
    return F.try_to_timestamp(F.when(text.rlike(_OFFSET), text).when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.concat(text, F.lit("+08:00"))))


def normalize_source_datetime(c: Column | str) -> Column:
    """``YYYYMMDD HH:MM:SS`` or ``YYYY-MM-DD HH:MM:SS`` as ISO with ``+08:00``; blanks are empty; anything else stays."""
    text = F.trim(_col(c).cast("string"))
    iso = r"^(\d{4})-?(\d\d)-?(\d\d) (\d\d:\d\d:\d\d)$"
    return F.when(blank(c), "").when(text.rlike(iso), F.regexp_replace(text, iso, "$1-$2-$3T$4+08:00")).otherwise(text)


def clean_date(c: Column | str) -> Column:
    """Any date-like value as ``YYYYMMDD``; blanks and impossible dates are null."""
    digits = F.substring(F.regexp_replace(_col(c).cast("string"), r"\D", ""), 1, 8)
    return F.when(~blank(c) & (F.length(digits) == 8) & F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull(), digits)


def first_available(columns: Sequence[str], rule: str, clock: str = "18:00:00") -> tuple[Column, Column]:
    """(``YYYYMMDD clock`` of the first usable date, the label of the column that won)."""
    stamp, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(columns):
        day = clean_date(c)
        stamp = F.when(day.isNotNull(), F.concat(day, F.lit(f" {clock}"))).otherwise(stamp)
        label = F.when(day.isNotNull(), F.lit(f"{rule}:{c}")).otherwise(label)
    return stamp, label


def fundamental_available_at(dataset: Column, announced: Column, first: Column, joined: Column) -> Column:
    """Stamp date by kind of dataset: statements try the first announcement, notices their own, audits a joined statement's."""
    own, early = clean_date(announced), clean_date(first)
    return F.when(dataset == "statement", F.coalesce(early, own)).when(dataset == "notice", own).when(dataset == "audit", F.coalesce(own, joined)).otherwise(F.coalesce(own, early))


def period_available_at(c: Column | str) -> tuple[Column, Column]:
    """(last day, label): a date is its own day; ``YYYYMM`` month end + 31 days; ``YYYYQn`` quarter end + 45 days."""
    p = _col(c)
    month = F.try_to_timestamp(F.concat(p, F.lit("01")), F.lit("yyyyMMdd")).cast("date")
    quarter = F.make_date(F.substring(p, 1, 4).try_cast("int"), F.substring(p, 6, 1).try_cast("int") * 3, F.lit(1))
    is_q, is_m, is_d = p.rlike(r"^\d{4}Q[1-4]$"), p.rlike(r"^\d{6}$"), p.rlike(r"^\d{8}$")
    day = F.when(is_d, F.try_to_timestamp(p, F.lit("yyyyMMdd")).cast("date")).when(is_m, F.date_add(F.last_day(month), 31)).when(is_q, F.date_add(F.last_day(quarter), 45))
    return F.date_format(day, "yyyyMMdd"), F.when(is_d, "date").when(is_m, "month_end_plus_31d").when(is_q, "quarter_end_plus_45d")


def combine_date_time(day: Column | str, clock: Column | str) -> Column:
    """``YYYYMMDD`` and ``H:MM[:SS]`` as ``YYYY-MM-DD HH:MM:SS``; out of range is null."""
    part = lambda k: F.regexp_extract(_col(clock), r"^(\d{1,2}):(\d\d)(?::(\d\d))?$", k)
    h, m, s = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0))
    d = clean_date(day)
    text = F.format_string("%s-%s-%s %02d:%02d:%02d", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2), h, m, s)
    return F.when(d.isNotNull() & h.between(0, 23) & m.between(0, 59) & s.between(0, 59), text)


#: Publication clocks (fixed values): rule -> (days after, clock).
CLOCKS = {"next_day_0900": (1, "09:00:00"), "same_day_0900": (0, "09:00:00"), "same_day_1900": (0, "19:00:00"), "next_day_0830": (1, "08:30:00"), "same_day_2000": (0, "20:00:00"), "final_2230": (0, "22:30:00")}


def official_available_at(day: Column | str, rule: Column | str, is_new: Column | str) -> Column:
    """The clock of the rule; the final one holds only for rows flagged Y; else the day's end."""
    date = F.try_to_timestamp(clean_date(day), F.lit("yyyyMMdd")).cast("date")
    at = lambda days, clock: F.concat(F.date_format(F.date_add(date, days), "yyyy-MM-dd"), F.lit(f" {clock}"))
    out = at(0, "23:59:59")
    for name, (days, clock) in CLOCKS.items():
        holds = _col(rule) == name
        out = F.when(holds & (_col(is_new) == "Y") if name == "final_2230" else holds, at(days, clock)).otherwise(out)
    return out


def text_available_at(source_time: Column | str, day: Column | str, fallback: str = "23:59:59") -> tuple[Column, Column]:
    """(stamp, rule): the source's time if it lies from a day before to three days after the date, else the date's fallback clock."""
    date = F.try_to_timestamp(clean_date(day), F.lit("yyyyMMdd"))
    when = F.try_to_timestamp(_col(source_time))
    gap = (F.unix_timestamp(when) - F.unix_timestamp(date)) / 86400.0
    fine = gap.between(-1, 3)
    late = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(f" {fallback}"))
    return F.when(fine, F.date_format(when, "yyyy-MM-dd HH:mm:ss")).otherwise(late), F.when(fine, "source_time").when(when.isNull(), "date_end").otherwise("implausible")


def minute_key(c: Column | str) -> Column:
    """Minutes since midnight of ``H:MM``, ``HHMM``, ``HMMSS``-like or 12+ digit stamps; anything else is null."""
    text = F.trim(_col(c).cast("string"))
    clock = r"(?:^|[ T])(\d{1,2}):(\d\d)(?::\d\d)?"
    digits = F.when(text.rlike(r"^\d{12,}$"), F.substring(text, 9, 4)).when(text.rlike(r"^\d{4}$"), text).when(text.rlike(r"^\d{6}$"), F.substring(text, 1, 4))
    hm = F.when(text.rlike(clock), F.concat(F.lpad(F.regexp_extract(text, clock, 1), 2, "0"), F.regexp_extract(text, clock, 2))).otherwise(digits)
    h, m = F.substring(hm, 1, 2).try_cast("int"), F.substring(hm, 3, 2).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)
