"""Drifting files: changes against a hand-made history, nulls, empty tables, clashing columns."""

from datetime import datetime

from rainloom.operators import schema_drift as D

FILES = "file_id long, logger_id long, station_id string, period_start timestamp, received timestamp, header string, column_types string"
LINES = "line_id long, file_id long, line_no int, payload string"


def _files(spark, rows):
    return spark.createDataFrame([(i, lg, "S", datetime(2020, 1, day) if day else None, datetime(2020, 2, 1), h, t) for i, lg, day, h, t in rows], FILES)


def _lines(spark, rows=()):
    return spark.createDataFrame([(*r, None)[:4] if len(r) == 3 else r for r in rows], LINES)


def _changes(spark, files, lines=()):
    found = D.schema_changes(_files(spark, files), _lines(spark, lines))
    return sorted((r.file_id, r.field_name, r.change) for r in found.collect())


def test_history(spark):
    files = [
        (1, 7, 1, "time;raw_drop_concentration;synop_ww", "datetime;list<float>;int"),
        (4, 7, 4, "TIME|N_D |synop_ww", "timestamp|INT[]|uint8"),  # arrives under another spelling, renamed and retyped
        (2, 7, 2, "time; raw_drop_concentration; SYNOP_WW", "datetime; FLOAT[]; INTEGER"),  # only spelling
        (3, 7, 3, "time;raw_drop_concentration", "datetime;array(float)"),
        (5, 8, 1, "time;field_04", None),
        (6, 8, 2, "time;field_04", None),
        (7, 8, 3, "time;field_04", None),
        (8, None, 3, "time;field_04", "datetime;int"),
        (9, 8, None, "time", None),
    ]
    lines = [
        (1, 5, 1, "2020-01-01 00:00:00;61"), (2, 5, 2, "2020-01-01 00:01:00;NaN"), (3, 5, 3, "2020-01-01 00:01"),
        (4, 6, 1, "2020-01-02 00:00:00;61.0;"), (5, 6, 2, "time;field_04"), (6, 6, 3, None),
        (7, 7, 1, "2020-01-03 00:00:00;"),
    ]
    assert _changes(spark, files, lines) == [
        (3, "weather_code_synop_4677", "removed"),
        (4, "raw_drop_concentration", "renamed"),
        (4, "raw_drop_concentration", "retyped"),
        (4, "weather_code_synop_4677", "added"),
        (6, "weather_code_synop_4677", "retyped"),  # file 7 tells nothing and keeps the kind
    ]


def test_empty_and_null(spark):
    assert _changes(spark, []) == []
    assert _changes(spark, [(1, 1, 1, None, None), (2, 1, 2, "", None)]) == []


def test_consistent_lines(spark):
    files = _files(spark, [(1, 1, 1, "time;n_d;ww_code", None), (2, 1, 2, "time|raw_drop_concentration", None)])
    lines = _lines(
        spark,
        [(1, 1, 1, '2020-01-01 00:00:00;"0,100,10";WW61'), (2, 1, 2, "time;n_d;ww_code"), (3, 1, 3, "2020-01-01"), (4, 2, 1, "2020-01-02 00:00:00|-9.999,1.5"), (5, 9, 1, "x"), (6, 2, 2, ""), (7, 1, 4, "a;b;c;d")],
    )
    rows = {r.line_id: r for r in D.consistent_lines(files, lines).collect()}
    assert rows[1].raw_drop_concentration == [-9.999, 2.0, 1.0] and rows[1].weather_code_synop_4677 == 61
    assert rows[4].raw_drop_concentration == [-9.999, 1.5] and rows[4].time == datetime(2020, 1, 2)
    assert [rows[i].line_status for i in (2, 3, 5, 6, 7)] == ["header", "cut", "no file", "empty", "stray"]


def test_versions_and_clashing_columns(spark):
    files = _files(spark, [(1, 1, 1, "time;n_d", "datetime;list<int>"), (2, 1, 2, "time;n_d", "datetime;list<int>"), (3, 1, 3, "time", "datetime")])
    clash = files.withColumn("version", files.file_id).withColumn("names", files.header)
    rows = {r.file_id: r for r in D.schema_versions(clash, _lines(spark)).collect()}
    assert [rows[i].version for i in (1, 2, 3)] == [1, 1, 2]
    assert "rename n_d -> raw_drop_concentration" in rows[1].migration


def test_unknown_names_are_learnt(spark):
    """A name that no rule knows is a rename where kind and place of time fit, and stays one; two candidates tell nothing."""
    files = [
        (1, 1, 1, "time;n_d;ww_code", "datetime;list<float>;int"),
        (2, 1, 2, "time;spec_new;ww_code;extra", "datetime;list<double>;int;int"),
        (3, 1, 3, "time;spec_new;ww_code", "datetime;int[];int"),
        (4, 2, 1, "time;n_d", "datetime;list<float>"),
        (5, 2, 2, "time;one;two", "datetime;list<float>;list<float>"),
        (6, 3, 1, "time;spec_new", "datetime;list<float>"),
    ]
    assert _changes(spark, files) == [(2, "raw_drop_concentration", "renamed"), (3, "raw_drop_concentration", "retyped"), (5, "raw_drop_concentration", "removed")]
    lines = _lines(spark, [(1, 2, 1, '2020-01-02 00:00:00;"1.5,-9.999";61;7'), (2, 3, 1, '2020-01-03 00:00:00;"0,100";61'), (3, 6, 1, '2020-01-01 00:00:00;"1.5"')])
    rows = {r.line_id: r for r in D.consistent_lines(_files(spark, files), lines).collect()}
    assert rows[1].raw_drop_concentration == [1.5, -9.999] and rows[2].raw_drop_concentration == [-9.999, 2.0] and rows[3].raw_drop_concentration is None


def test_changes_and_lines_follow_the_recorded_steps(spark):
    files = _files(spark, [(1, 1, 1, "time;n_d;ww_code", "datetime;list<int>;text"), (2, None, 1, "time|ww_4677", "datetime|text")])
    rows = {r.file_id: r for r in D.schema_versions(files, _lines(spark)).collect()}
    steps = {s.field: s for s in rows[1].steps}
    assert (steps["raw_drop_concentration"].action, steps["raw_drop_concentration"].source, steps["raw_drop_concentration"].kind) == ("rename", "n_d", "list of integers")
    assert steps["mor_visibility"].action == "default" and steps["time"].action == "keep" and steps["weather_code_synop_4677"].position == 3
    assert rows[2].version is None and len(rows[2].steps) == len(steps)
