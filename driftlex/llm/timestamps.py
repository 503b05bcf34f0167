"""Timestamps of mixed formats, as microseconds since 1970 in UTC.

Two passes over the rows, each one ``mapInPandas`` with one compiled pattern and
``datetime``. The first reads the slashed stamps and counts, by source, those
that are possible in one order of day and month only; the sums decide the order
of a source. The second resolves all stamps with these decisions, which are
broadcast where they are few and short, and otherwise joined in salted parts.

A wall time's offset is that of ``zoneinfo`` with fold 0, the offset before a
change. Where fold 1 gives another, the way to UTC and back tells a skipped time
(it comes back different) from a repeated one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlex.llm.scratch import materialise

SPACE = " \t\n\x0b\x0c\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
STAMP = re.compile(
    rf"""
    (?P<epoch>[0-9]{{10}}(?:[0-9]{{3}})?)
    | (?: (?P<iso>20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})
        | (?P<compact>20[0-9]{{6}})
        | (?P<dotted>[0-9]{{2}}\.[0-9]{{2}}\.20[0-9]{{2}})
        | (?P<day>[0-9]{{2}})\x20(?P<month>{"|".join(MONTHS)})\x20(?P<year>20[0-9]{{2}})
        | (?P<one>[0-9]{{2}})/(?P<two>[0-9]{{2}})/(?P<slashed>20[0-9]{{2}})
      )
      (?: [T\x20](?P<h>[0-9]{{2}}):(?P<m>[0-9]{{2}})(?::(?P<s>[0-9]{{2}}))?
          (?:\x20?(?P<half>[AP])M)?
          (?:\x20?(?:(?P<utc>Z)|(?P<sign>[+-])(?P<oh>[0-9]{{2}}):?(?P<om>[0-9]{{2}})))? )?
    """,
    re.VERBOSE,
)
#: Votes that an order needs, as a multiple of the other's: more than this.
MARGIN = 1.0
#: Decisions that may be broadcast, and bytes of their sources' names; beyond either they are joined.
MOST_SOURCES, MOST_BYTES = 20_000, 2 << 20
#: Parts that the rows of one source are joined in.
SALTS = 64
DAY_FIRST, MONTH_FIRST = "dm", "md"


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (OSError, ValueError, KeyError):  # a folder's name, a path, an unknown key
        return None


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


class Stamp:
    """What a text says: ``epoch_us``, or the days it can mean (day first, month first) with a time and an offset."""

    __slots__ = ("epoch_us", "day_first", "month_first", "seconds", "offset")

    def __init__(self, epoch_us=None, day_first=None, month_first=None, seconds=0, offset=None):
        self.epoch_us, self.day_first, self.month_first, self.seconds, self.offset = epoch_us, day_first, month_first, seconds, offset

    @property
    def vote(self) -> str | None:
        """The only order that gives a day."""
        if self.day_first is None:
            return MONTH_FIRST if self.month_first is not None else None
        return DAY_FIRST if self.month_first is None else None


def read(raw: str | None, zone: str | None) -> tuple[Stamp, bool] | None:
    """A stamp and whether it is slashed; None for a bad one, which has no date, no possible time, or neither offset nor known zone."""
    found = STAMP.fullmatch(raw.strip(SPACE)) if raw is not None else None
    if found is None:
        return None
    g = found.group
    if digits := g("epoch"):
        return Stamp(epoch_us=int(digits) * (1_000_000 if len(digits) == 10 else 1000)), False
    seconds, offset = 0, None
    if g("h") is not None:
        h, m, s = int(g("h")), int(g("m")), int(g("s") or 0)
        if g("half"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if g("half") == "P" else 0)
        if h > 23 or m > 59 or s > 59:
            return None
        seconds = 3600 * h + 60 * m + s
        if g("utc"):
            offset = 0
        elif g("sign"):
            oh, om = int(g("oh")), int(g("om"))
            if oh > 14 or om > 59:
                return None
            offset = (3600 * oh + 60 * om) * (-1 if g("sign") == "-" else 1)
    if offset is None and _zone(zone) is None:
        return None
    if year := g("slashed"):
        y, one, two = int(year), int(g("one")), int(g("two"))
        both = _day(y, two, one), _day(y, one, two)
        return None if both == (None, None) else (Stamp(None, *both, seconds, offset), True)
    if x := g("iso"):
        day = _day(int(x[:4]), int(x[5:7]), int(x[8:]))
    elif x := g("compact"):
        day = _day(int(x[:4]), int(x[4:6]), int(x[6:]))
    elif x := g("dotted"):
        day = _day(int(x[6:]), int(x[3:5]), int(x[:2]))
    else:
        day = _day(int(g("year")), 1 + MONTHS.index(g("month")), int(g("day")))
    return None if day is None else (Stamp(None, day, day, seconds, offset), False)


def to_utc(day: date, seconds: int, offset: int | None, zone: str | None) -> tuple[int, str | None]:
    """(microseconds since 1970, ``gap`` or ``repeat`` or None)."""
    wall = None
    if offset is None:
        z = _zone(zone)
        local = datetime(day.year, day.month, day.day, seconds // 3600, seconds // 60 % 60, seconds % 60, tzinfo=z)
        before = local.utcoffset()
        if before != local.replace(fold=1).utcoffset():
            back = local.astimezone(UTC).astimezone(z)
            wall = "repeat" if back.replace(tzinfo=None, fold=0) == local.replace(tzinfo=None) else "gap"
        offset = before // timedelta(seconds=1)
    return ((day.toordinal() - 719_163) * 86_400 + seconds - offset) * 1_000_000, wall


def resolve(raw: str | None, zone: str | None, order: str | None) -> tuple[int | None, str, bool, str | None]:
    """(utc_us, rule, ambiguous, wall) of one stamp, with its source's order of day and month if that is decided."""
    found = read(raw, zone)
    if found is None:
        return None, "bad", False, None
    stamp, slashed = found
    if stamp.epoch_us is not None:
        return stamp.epoch_us, "epoch", False, None
    rule, day = "plain", stamp.day_first or stamp.month_first
    if slashed and stamp.vote is None and stamp.day_first != stamp.month_first:
        rule = "votes" if order else "default"
        day = stamp.day_first if order == DAY_FIRST else stamp.month_first
    us, wall = to_utc(day, stamp.seconds, stamp.offset, zone)
    return us, rule, rule != "plain" or wall is not None, wall


def _is_slashed(raw: str) -> Column:
    return F.coalesce(F.contains(F.col(raw), F.lit("/")), F.lit(False))


def votes(stamps: DataFrame, source: str = "source", zone: str = "zone", raw: str = "raw") -> DataFrame:
    """(source, day_first, month_first): slashed stamps of each source that are possible in that order only. A null source is one of its own."""
    some = stamps.where(_is_slashed(raw)).select(F.col(source).cast("string").alias("source"), F.col(zone).cast("string").alias("zone"), F.col(raw).cast("string").alias("raw"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: dict = {}
            for name, at, text in zip(b["source"].tolist(), b["zone"].tolist(), b["raw"].tolist(), strict=True):
                found = read(text, at)
                if found and (vote := found[0].vote):
                    count.setdefault(name, [0, 0])[vote == MONTH_FIRST] += 1
            yield pd.DataFrame([(k, *v) for k, v in count.items()], columns=["source", "day_first", "month_first"]).astype({"source": object, "day_first": "int64", "month_first": "int64"})

    counted = some.mapInPandas(run, "source string, day_first long, month_first long")
    return counted.groupBy("source").agg(F.sum("day_first").alias("day_first"), F.sum("month_first").alias("month_first"))


def decisions(counted: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(source, order) of the sources where one order has over ``margin`` times the other's votes."""
    won = lambda a, b: F.col(a) > F.lit(float(margin)) * F.col(b)
    order = F.when(won("day_first", "month_first"), DAY_FIRST).when(won("month_first", "day_first"), MONTH_FIRST)
    return counted.select("source", order.alias("order")).where("order is not null")


def _with_order(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``__order`` beside each row that may need it."""
    size = decided.agg(F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    decided = decided.select(F.col("source").alias("__key"), F.col("order").alias("__order"))
    if size["n"] <= MOST_SOURCES and (size["bytes"] or 0) <= MOST_BYTES:
        return rows.join(F.broadcast(decided), F.col("__source").eqNullSafe(F.col("__key")), "left").drop("__key")
    need = rows.where(_is_slashed("__raw")).withColumn("__salt", F.pmod(F.xxhash64("__raw", "__zone", "__spread"), F.lit(SALTS)).cast("int"))
    parts = decided.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("__source").eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__part"))
    joined = need.join(parts, on, "left").drop("__key", "__salt", "__part")
    return joined.unionByName(rows.where(~_is_slashed("__raw")).withColumn("__order", F.lit(None).cast("string")))


def normalise(stamps: DataFrame, *columns: str, source: str = "source", zone: str = "zone", raw: str = "raw", margin: float = MARGIN) -> DataFrame:
    """``columns`` of stamps with ``utc_us``, ``rule``, ``ambiguous`` and ``wall`` (``gap``, ``repeat`` or null), a row for each row.

    A null, empty or unreadable stamp is bad, as is one without offset whose zone is null or unknown; bad ones
    don't vote. Null sources vote together. Repeated rows vote and are resolved each by itself. A tie of votes
    leaves the default, month first. Texts of any length are read whole. Columns that aren't asked for are left
    out, whatever their names; asked-for ones may not be called as the four results. An empty table gives an
    empty result.
    """
    decided = materialise(decisions(votes(stamps, source, zone, raw), margin), "orders")
    kept = stamps.select(*columns).schema.fields
    text = lambda name, to: F.col(name).cast("string").alias(to)
    rows = stamps.select(*columns, text(source, "__source"), text(zone, "__zone"), text(raw, "__raw"))
    spread = F.xxhash64(*columns) if columns else F.lit(0).cast("long")
    rows = _with_order(rows.withColumn("__spread", spread), decided).select(*columns, "__zone", "__raw", "__order")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [resolve(*x) for x in zip(b["__raw"].tolist(), b["__zone"].tolist(), b["__order"].tolist(), strict=True)]
            out = b[list(columns)].copy()
            out["utc_us"] = pd.array([x[0] for x in found], "Int64")
            out["rule"] = [x[1] for x in found]
            out["ambiguous"] = [x[2] for x in found]
            out["wall"] = pd.Series([x[3] for x in found], dtype=object, index=out.index)
            yield out

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInPandas(run, schema + "utc_us long, rule string, ambiguous boolean, wall string")


def op11_timestamps(spark, sf_dir: str) -> DataFrame:
    return normalise(spark.read.parquet(f"{sf_dir}/stamps.parquet"), "stamp_id").drop("wall")


_SQL_STAMP = (
    r"^(?:(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})"
    rf"|([0-9]{{2}}) ({'|'.join(MONTHS)}) (20[0-9]{{2}})|([0-9]{{2}})/([0-9]{{2}})/(20[0-9]{{2}}))"
    r"(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?)$"
)
OP11_SQL = f"""
with s as (select stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as r from stamps),
g as (select *, regexp_full_match(r, '[0-9]{{10}}|[0-9]{{13}}') as epoch, regexp_matches(r, '{_SQL_STAMP}') as dated,
    regexp_extract(r, '{_SQL_STAMP}', ['y1','m1','d1','y2','m2','d2','d3','m3','y3','d4','m4','y4','a','b','y5','h','mi','s','half','off']) as x from s),
w as (select *, x.y5 <> '' as slashed,
    case when x.half = '' then try_cast(x.h as integer)
         when try_cast(x.h as integer) between 1 and 12 then try_cast(x.h as integer) % 12 + case when x.half = 'P' then 12 else 0 end end as hour,
    coalesce(try_cast(x.mi as integer), 0) as minute, coalesce(try_cast(x.s as integer), 0) as second,
    case when x.off = 'Z' then 0 when x.off <> '' then (case when x.off[1] = '-' then -1 else 1 end) * (try_cast(x.off[2:3] as integer) * 60 + try_cast(right(x.off, 2) as integer)) end as minutes_off,
    case when x.y1 <> '' then try_cast(x.y1 || '-' || x.m1 || '-' || x.d1 as date) when x.y2 <> '' then try_cast(x.y2 || '-' || x.m2 || '-' || x.d2 as date)
         when x.y3 <> '' then try_cast(x.y3 || '-' || x.m3 || '-' || x.d3 as date)
         when x.y4 <> '' then try_cast(x.y4 || '-' || lpad(cast(list_position([{', '.join(f"'{m}'" for m in MONTHS)}], x.m4) as varchar), 2, '0') || '-' || x.d4 as date)
         else try_cast(x.y5 || '-' || x.b || '-' || x.a as date) end as dm,
    case when x.y5 <> '' then try_cast(x.y5 || '-' || x.a || '-' || x.b as date) end as md0 from g),
v as (select *, case when slashed then md0 else dm end as md,
    dated and (x.h = '' or hour between 0 and 23) and minute <= 59 and second <= 59
      and (x.off in ('', 'Z') or (try_cast(x.off[2:3] as integer) <= 14 and try_cast(right(x.off, 2) as integer) <= 59))
      and (minutes_off is not null or zone in (select name from pg_timezone_names())) and (dm is not null or (slashed and md0 is not null)) as good from w),
polls as (select source, count(*) filter (md is null) as d, count(*) filter (dm is null) as m from v where good and slashed group by 1),
o as (select v.*, case when epoch then 'epoch' when good is not true then 'bad'
      when slashed and dm is not null and md is not null and dm <> md then case when p.d <> p.m then 'votes' else 'default' end else 'plain' end as rule,
    case when dm is null then md when md is null then dm when slashed and coalesce(p.d, 0) <= coalesce(p.m, 0) then md else dm end as day
    from v left join polls p on v.source is not distinct from p.source),
t as (select *, case when rule not in ('bad', 'epoch') then cast(day as timestamp) + to_seconds(coalesce(hour, 0) * 3600 + minute * 60 + second) end as wall from o),
z as (select *, case when minutes_off is null and wall is not null then timezone(zone, wall) end as late from t),
y as (select *, case when late is null then null when timezone(zone, late - interval 2 hour) = wall then late - interval 2 hour
      when timezone(zone, late - interval 1 hour) = wall then late - interval 1 hour
      when timezone(zone, late - interval 30 minute) = wall then late - interval 30 minute else late end as early from z)
select stamp_id, cast(case rule when 'bad' then null when 'epoch' then cast(r as bigint) * case when length(r) = 10 then 1000000 else 1000 end
    else case when late is null then epoch_us(wall) - cast(minutes_off as bigint) * 60000000 else epoch_us(early) end end as bigint) as utc_us, rule,
  rule in ('votes', 'default') or (late is not null and (early <> late or timezone(zone, late) <> wall)) as ambiguous
from y"""
