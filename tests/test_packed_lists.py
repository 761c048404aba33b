"""The byte kernel against a plain parser."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rainloom.operators import packed_lists as P


def plain(text, n):
    if text is None or n < 1:
        return None
    for decimal in (False, True):
        inside, out = False, []
        for i, c in enumerate(text):
            if c == '"':
                inside = not inside
            elif c == ",":
                mark = 0 < i < len(text) - 1 and text[i - 1] in "0123456789" and text[i + 1] in "0123456789" if decimal else inside and text.count('"') > 2
                out.append("." if mark else ";")
            else:
                out.append(";" if c in "|\t" else c)
        joined = re.sub(r" +", ";", re.sub(r" *; *", ";", "".join(out).strip(" ")))
        joined = joined.removeprefix(";")
        cells = joined.removesuffix(";").split(";")
        if len(cells) == n and (joined or "".join(out).strip(" ")):
            if not all(c == "" or re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", c) for c in cells):
                return None
            return [float(c or 0) for c in cells]
    return None


def parsed(texts, n):
    return P.parse_lists(pa.array(texts, pa.string()), np.full(len(texts), n))[0].to_pylist()


def test_notations():
    texts = [
        "1,2,3", ",1,,3,", "1;2;3", '"1,5","2","3"', "1,5|2,5|3,5", '"1 2 3"', " 1   2 3 ", "1; 2 ;3", "1,2;3", "+1 -2 3e2", "1,2,x", "1,2", "", "0", None, "NaN", "1\t2\t3", "1.2.3,1,2", '""', "é,1,2",
    ]
    assert parsed(texts, 3) == [plain(t, 3) for t in texts]
    assert parsed(["1,5;2"], 2) == [[1.5, 2.0]]
    assert parsed([], 3) == [] and parsed(["1"], 0) == [None]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.from_regex(r'[",;| ]?([0-9.+-]{1,4}[,;|\t ]{1,2}){1,5}[0-9]{1,3}[";]?', fullmatch=True)), max_size=8), st.integers(2, 5))
def test_against_plain(texts, n):
    assert parsed(texts, n) == [plain(t, n) for t in texts]


def test_long_text_and_slices():
    text = ",".join(["007"] * 1024)
    whole = pa.array(["x", text, None, text], pa.string())
    lists, sound = P.parse_lists(whole.slice(1), np.full(3, 1024))
    assert sound.tolist() == [True, False, True] and lists.to_pylist()[2] == [7.0] * 1024


def test_entries(spark):
    telegrams = spark.createDataFrame(
        [(1, "R", ",".join(["0"] * 18 + ["3", "4"]), "1", None, "x"), (2, "R", "0", None, None, "x"), (None, "R", None, None, None, "x"), (3, None, "1", None, None, "x"), (4, "?", "1", None, None, "x")],
        "telegram_id long, station_id string, raw_drop_number string, raw_drop_concentration string, raw_drop_average_velocity string, sensor_name string",
    )
    stations = spark.createDataFrame([("R", "RD80"), ("R", "RD80"), ("?", None)], "station_id string, sensor_name string")
    rows = P.entries(telegrams, stations, drops_only=True).collect()
    assert sorted((r.telegram_id, r.field_name, r.pos, r.value) for r in rows) == [(1, "raw_drop_number", 18, 3.0), (1, "raw_drop_number", 19, 4.0)]
    assert P.entries(telegrams, stations).count() == 20
    assert P.entries(telegrams.limit(0), stations).count() == 0
