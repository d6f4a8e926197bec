"""Column functions on golden rows."""

import pytest
from pyspark.sql import functions as F

from railweave.functions import clock, geo, keys, names


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Кемеровский АВ", "Кемеровский автовокзал", 1.0), ("Томск речной", "Томск", 0.95), ("Новосибирск", "Новосибирск2", 0.9), ("АВ", "АВ", 1.0), ("Омск", "Орск", 0.75)],
)
def test_similarity(spark, a, b, want):
    assert one(spark, names.name_similarity(F.lit(a), F.lit(b)))[0] == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("ОП г. Бердск", "бердск"), ("с. Верх Тула школа", "верх тула"), ("Кемеровский АВ", "кемеровский"), ("Вокзал", ""), ("", "")])
def test_settlement(spark, text, want):
    assert one(spark, names.extract_settlement(F.lit(text)))[0] == want


def test_same_settlement_and_keys(spark):
    for a, b, want in (("Мариинский", "Мариинск", True), ("Кемеровский", "Кемерово", True), ("Томск", "Омск", False), ("", "Омск", False)):
        same, shared = one(spark, names.same_settlement(F.lit(a), F.lit(b)), F.arrays_overlap(names.settlement_keys(F.lit(a)), names.settlement_keys(F.lit(b))))
        assert same == want
        assert shared or not want


def test_villages_and_types(spark):
    for text, village, kind in (("ОП «Сад»", True, "platform"), ("пов. на Сад", True, "platform"), ("Оптика", False, "station"), ("Томск АВ", False, "hub"), ("Аэропорт", False, "airport")):
        assert tuple(one(spark, names.is_village_name(F.lit(text)), names.infer_stop_type(F.lit(text)))) == (village, kind)


def test_latin(spark):
    assert tuple(one(spark, names.transliterate(F.lit("Щёлково")), names.translate_admin(F.lit("Томская область")), names.translate_admin(F.lit("Республика Коми")), names.slug(F.lit("Щёлково, АВ!")))) == ("Shhyolkovo", "Tomskaya Oblast", "Komi Republic", "shchyolkovo-av")


def test_distance(spark):
    km, none = one(spark, geo.haversine_km(F.lit(55.0), F.lit(83.0), F.lit(55.0), F.lit(84.0)), geo.haversine_km(F.lit(None).cast("double"), F.lit(83.0), F.lit(55.0), F.lit(84.0)))
    assert km == pytest.approx(63.78, abs=0.01)
    assert none is None


def test_cell_times(spark):
    for text, want in (("07:30", (450, None, True)), ("7:05 (пн, ср)", (425, [1, 3], True)), ("24:00", (None, None, False)), ("07:30 (завтра)", (None, None, False)), ("нет", (None, None, False))):
        assert tuple(one(spark, clock.parse_cell_time(F.lit(text)))[0]) == want


def test_block_days(spark):
    for text, want in (("", ("all", None)), (None, ("all", None)), ("Ежедневно", ("all", None)), ("нет отправлений", ("none", None)), ("через день", ("parity", None)), ("пт; пн, вс", ("days", [0, 1, 5])), ("завтра", ("error", None))):
        assert tuple(one(spark, clock.parse_block_days(F.lit(text)))[0]) == want


@pytest.mark.parametrize("parse", [clock.parse_cell_time, clock.parse_block_days])
def test_parsers_work_out_their_text_once(spark, parse):
    # Named dozens of times, what makes the text was worked out anew at each mention.
    made = spark.range(1).select(parse(F.concat(F.lit("10:"), F.col("id").cast("string"))).alias("x"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("id#") <= 3


def test_feed_fields(spark):
    assert tuple(one(spark, clock.feed_seconds(F.lit("25:10")), clock.feed_seconds(F.lit("1:02:03")), clock.feed_seconds(F.lit("x")), clock.feed_hms(F.lit(90065)))) == (90600, 3723, None, "25:01:05")
    assert one(spark, clock.parse_days_range(F.lit("пт-пн")))[0] == [0, 1, 5, 6]


def test_keys(spark):
    key, low, price, money = one(spark, keys.route_key_of_code(F.lit("54.101.2"), F.lit("А Б"), F.lit(""), F.lit("77")), keys.surrogate_id(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), keys.price_estimate(F.lit(100.0), F.lit("rail")), keys.currency_or_default(F.lit("eur ")))
    assert (key, price, money) == ("synthetic:54:101-2:А-Б:x:77", 350.0, "EUR")
    assert low < 0
