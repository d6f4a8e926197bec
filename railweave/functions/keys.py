"""Natural keys, stable ids, tariffs and lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price for a kilometre by mode; other modes cost 2.5.
PRICE_KM = {"flight": 8.0, "rail": 3.5, "tram": 2.0, "metro": 2.0}
# Currencies in use; anything else counts in the first.
CURRENCY = ("RUB", "USD", "EUR", "KZT", "BYN", "CNY")
# Level of a map's administrative level.
ADMIN_LEVEL = {2: 0, 3: 1, 4: 2, 6: 3, 8: 4, 9: 5, 10: 5}
LEVEL_NAME = ("country", "federal_district", "region", "district", "city", "city_district")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _part(c: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.btrim(F.substring(clean, 1, 40), F.lit("-")), F.lit("")), F.lit("x"))


def synthetic_route_key(region: Column, number: Column, first: Column, last: Column, tax_id: Column) -> Column:
    """Key of a route without one, from five cleaned parts of 40 characters."""
    return F.concat_ws(":", F.lit("synthetic"), *map(_part, (region, number, first, last, tax_id)))


def route_key_of_code(code: Column, first: Column, last: Column, tax_id: Column) -> Column:
    """The same from a route code REGION.NUMBER."""
    region = F.split_part(code, F.lit("."), F.lit(1))
    number = F.when(F.contains(code, F.lit(".")), F.replace(code.substr(F.length(region) + 2, F.length(code)), F.lit("."), F.lit("-"))).otherwise(F.lit("x"))
    return synthetic_route_key(region, number, first, last, tax_id)


def split_trip_key(c: Column) -> Column:
    """The part behind the last bar."""
    return F.substring_index(c, "|", -1)


def direction_id(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "forward", 0).when(low == "backward", 1)


def surrogate_id(kind: Column, reason: Column, source: Column, code: Column) -> Column:
    """Stable negative id of a record without one."""
    h = F.xxhash64(F.concat_ws(chr(0), kind, reason, source, code))
    return F.when(h >= 0, -h - 1).otherwise(h)


def plan_id(version: Column, config: Column, inputs: Column) -> Column:
    """Hash of version, configuration and the input hashes, whose order doesn't matter."""
    return F.sha2(F.concat_ws(chr(0), version, config, F.array_join(F.array_sort(inputs), chr(0))), 256)


def is_fresh(done: Column, plan: Column) -> Column:
    return F.coalesce(done == plan, F.lit(False))


def price_estimate(km: Column, mode: Column) -> Column:
    """Price by distance and mode, 1 km and 50 at least, rounded half up."""
    rate = F.coalesce(F.try_element_at(_map(PRICE_KM), mode), F.lit(2.5))
    return F.floor(F.greatest(F.lit(50.0), F.greatest(F.lit(1.0), km) * rate) + 0.5).cast("double")


def currency_or_default(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(up.isin(*CURRENCY), up).otherwise(CURRENCY[0])


def admin_level(c: Column) -> Column:
    """Level 0 (country) to 5 (city district), NULL if the map's level has none."""
    return F.try_element_at(_map(ADMIN_LEVEL), c)


def level_name(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(dict(enumerate(LEVEL_NAME))), c), F.lit("unknown"))


def geocode_query(region_name: Column, text: Column) -> Column:
    """The text with its region before it, if there is one."""
    return F.when(F.coalesce(region_name, F.lit("")) == "", text).otherwise(F.concat(region_name, F.lit(", "), text))
