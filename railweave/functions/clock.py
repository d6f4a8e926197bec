"""Clock times, weekday lists and feed fields as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday numbers, 0 = Sunday.
WEEKDAY = {"вс": 0, "пн": 1, "вт": 2, "ср": 3, "чт": 4, "пт": 5, "сб": 6}
# Longer weekday forms of older sheets.
WEEKDAY_LONG = {
    "пн": 1, "пон": 1, "понедельник": 1, "вт": 2, "вторник": 2, "ср": 3, "среда": 3, "чт": 4, "четверг": 4,
    "пт": 5, "пятница": 5, "сб": 6, "суббота": 6, "вс": 0, "воскресенье": 0, "вск": 0,
}
# Phrases for no service and for every day.
NO_SERVICE = ("нет", "нет отправлений", "нет отправлении")
EVERY_DAY = ("", "ежедневно", "ежедневн", "ежедневный", "через день", "1 через 1", "1через1")
# Speed caps in km/h; other modes have the bus cap.
SPEED = {"flight": 1000.0, "rail": 250.0, "bus": 120.0, "coach": 120.0, "tram": 120.0, "metro": 120.0}
# Feed route types.
FEED_MODE = {0: "tram", 1: "rail", 2: "rail", 4: "flight"}
ROUTE_TYPE = {"tram": 0, "rail": 2, "bus": 3, "flight": 1100}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _ints() -> Column:
    return F.array().cast("array<int>")


# A list of short weekday names up to the end of the text or a semicolon. Such lists are read by patterns and not by
# lambdas, which Spark neither compiles nor works out only once where an expression names them several times.
DAYS = rf"[,\s]*(?:(?:{'|'.join(WEEKDAY)})(?:[,\s]+|(?=;|\z)))+"


def _days_named(low: Column) -> Column:
    """Weekday numbers, in order, whose names a text of valid lists holds."""
    named = F.array(*[F.when(F.contains(low, F.lit(name)), F.lit(day)) for name, day in sorted(WEEKDAY.items(), key=lambda x: x[1])])
    return F.array_except(named, F.array(F.lit(None).cast("int")))


def day_list(c: Column) -> Column:
    """Weekday numbers of a list of short names; NULL if a name is unknown or none is there."""
    low = F.lower(c)
    return F.when(low.rlike(rf"\A{DAYS}\z"), _days_named(low))


def is_no_service(c: Column) -> Column:
    return F.lower(F.trim(c)).startswith("нет")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def parse_cell_time(c: Column) -> Column:
    """Struct (minutes, days, ok) of an hour, a colon, two digits of minutes and perhaps days in brackets; days NULL where the cell names none."""

    def cut(text):
        noted = F.contains(text, F.lit("("))
        clock = F.split(F.rtrim(F.split_part(text, F.lit("("), F.lit(1))), ":")
        # What is between the first bracket and the last sign, which must be the only closing one.
        note = text.substr(F.instr(text, "(") + 1, F.length(text) - F.instr(text, "(") - 1)
        return F.struct(clock.alias("clock"), F.when(noted, F.trim(note)).otherwise("").alias("inner"), (~noted | (text.endswith(")") & ~F.contains(note, F.lit(")")))).alias("closed"))

    def read(x):
        hour, minute = (F.try_element_at(x["clock"], F.lit(i)) for i in (1, 2))
        shaped = (F.size(x["clock"]) == 2) & hour.rlike("^[0-9]{1,2}$") & minute.rlike("^[0-9]{2}$") & x["closed"]
        days = F.when(x["inner"] != "", day_list(x["inner"]))
        return F.struct(shaped.alias("shaped"), hour.try_cast("int").alias("h"), minute.try_cast("int").alias("m"), (x["inner"] == "").alias("bare"), days.alias("days"))

    def checked(x):
        ok = x["shaped"] & (x["h"] <= 23) & (x["m"] <= 59) & (x["bare"] | x["days"].isNotNull())
        return F.struct((x["h"] * 60 + x["m"]).alias("minutes"), x["days"].alias("days"), F.coalesce(ok, F.lit(False)).alias("ok"))

    only = lambda x: F.struct(F.when(x["ok"], x["minutes"]).alias("minutes"), F.when(x["ok"], x["days"]).alias("days"), x["ok"].alias("ok"))
    return _let(_let(_let(_let(F.trim(c), cut), read), checked), only)


def parse_block_days(c: Column) -> Column:
    """Struct (kind, days); kind is all, none, parity, days or error."""

    def read(low):
        daily = low.rlike(rf"\A(?:(?: *|{DAYS});)* *ежедневно *(?:;|\z)")  # what is before it must be lists
        lists = low.rlike(rf"\A(?: *|{DAYS})(?:;(?: *|{DAYS}))*\z") & low.rlike("[^; ]")
        kind = F.when(low == "", "all").when(low.startswith("нет"), "none").when(F.contains(low, F.lit("через")), "parity").when(daily, "all").when(lists, "days").otherwise("error")
        return F.struct(kind.alias("kind"), low.alias("low"))

    told = lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "days", _days_named(x["low"])).alias("days"))
    return _let(_let(F.lower(F.trim(F.coalesce(c, F.lit("")))), read), told)


def parse_days_range(c: Column) -> Column:
    """Weekday list of older sheets; ranges wrap round the week, what isn't understood means all."""
    s = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "ё", "е")
    every = F.sequence(F.lit(0), F.lit(6))
    tokens = F.filter(F.transform(F.split(F.translate(s, "; ", ",,"), ","), lambda t: F.btrim(t, F.lit(". "))), lambda t: t != "")

    def one(t):
        a, b = (F.try_element_at(_map(WEEKDAY_LONG), F.trim(F.split_part(t, F.lit("-"), F.lit(i)))) for i in (1, 2))
        ranged = F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), lambda k: F.pmod(a + k, F.lit(7)))
        single = F.try_element_at(_map(WEEKDAY_LONG), t)
        return F.when(F.contains(t, F.lit("-")) & a.isNotNull() & b.isNotNull(), ranged).when(single.isNotNull(), F.array(single)).when(t.rlike(r"^\d+через\d+$"), every).otherwise(_ints())

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, one))))
    return F.when(s.isin(*NO_SERVICE), _ints()).when(s.isin(*EVERY_DAY), every).when(F.size(found) > 0, found).otherwise(every)


def parse_period(c: Column, snapshot: Column) -> Column:
    """Struct (start, end) in the snapshot's year, the whole year if no two dates are named."""
    year = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(snapshot, F.lit("")), r"^(\d{4})", 1), F.lit("")), F.lit("2026"))
    dates = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]{2}[.][0-9]{2}"), F.lit(0)), lambda d: F.concat_ws("-", year, F.split_part(d, F.lit("."), F.lit(2)), F.split_part(d, F.lit("."), F.lit(1))))
    has = F.size(dates) >= 2
    start = F.when(has, F.try_element_at(dates, F.lit(1))).otherwise(F.concat(year, F.lit("-01-01")))
    end = F.when(has, F.try_element_at(dates, F.lit(2))).otherwise(F.concat(year, F.lit("-12-31")))
    return F.struct(start.alias("start"), end.alias("end"))


def feed_seconds(c: Column) -> Column:
    """Seconds of H:MM[:SS]; hours may pass 24; NULL if it is no time."""
    p = F.split(F.trim(c), ":")
    h, m, s = (F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when((F.size(p) == 2) & h.isNotNull() & m.isNotNull(), h * 3600 + m * 60).when((F.size(p) == 3) & h.isNotNull() & m.isNotNull() & s.isNotNull(), h * 3600 + m * 60 + s)


def feed_hms(c: Column) -> Column:
    """HH:MM:SS of seconds, past 24 hours if need be."""
    return F.format_string("%02d:%02d:%02d", F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60)


def feed_date(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{8}$"), F.try_to_date(F.trim(c), "yyyyMMdd"))


def normalize_time(c: Column) -> Column:
    """HH:MM:SS of a loosely written time."""
    return feed_hms(feed_seconds(c))


def feed_mode(c: Column) -> Column:
    """Mode of a feed's route type; bus if it is another."""
    return F.coalesce(F.try_element_at(_map(FEED_MODE), c.try_cast("int")), F.lit("bus"))


def route_type(mode: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ROUTE_TYPE), mode), F.lit(3))


def max_speed(mode: Column) -> Column:
    """Speed cap of a mode in km/h."""
    return F.coalesce(F.try_element_at(_map(SPEED), mode), F.lit(120.0))


def weekday(date: Column) -> Column:
    return F.dayofweek(date) - 1


def weekday_csv(days: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.array_distinct(days)), lambda d: d.cast("string")), ",")


def weekday_flags(days: Column) -> list[Column]:
    """Seven 0/1 columns from monday to sunday."""
    names = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return [F.array_contains(days, F.lit((i + 1) % 7)).cast("int").alias(n) for i, n in enumerate(names)]


def intersect_days(a: Column, b: Column) -> Column:
    """Days in both sets, in order."""
    return F.array_sort(F.array_intersect(a, b))
