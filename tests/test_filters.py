from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls

BRACKET = ["2025-12-30 08:00:00 [INFO] ok", "2025-12-30 09:00:00 [WARNING] warn", "2025-12-30 10:00:00 [ERROR] err"]


def at(*args):
    return datetime(*args, tzinfo=UTC)


@pytest.mark.parametrize(
    "selector,want",
    [
        (dict(date="2025-12-30"), (at(2025, 12, 30), at(2025, 12, 31))),
        (dict(hour="2025-12-30T08"), (at(2025, 12, 30, 8), at(2025, 12, 30, 9))),
        (dict(hour="2025-12-30T01:45+02:00"), (at(2025, 12, 29, 23), at(2025, 12, 30))),
        (dict(week="2025-W52"), (at(2025, 12, 22), at(2025, 12, 29))),
        (dict(month="2025-12"), (at(2025, 12, 1), at(2026, 1, 1))),
        (dict(month="2025-02"), (at(2025, 2, 1), at(2025, 3, 1))),
        (dict(year="2025"), (at(2025, 1, 1), at(2026, 1, 1))),
        (dict(since="2025-12-30T08:00:00Z", until="2025-12-30"), (at(2025, 12, 30, 8), at(2025, 12, 30))),
        (dict(since="2025-12-30T08:00:00+02:00"), (at(2025, 12, 30, 6), None)),
        (dict(days_lookback=2, as_of=at(2025, 1, 3)), (at(2025, 1, 1), at(2025, 1, 3))),
        (dict(hours_lookback=0, as_of=at(2025, 1, 3)), (at(2025, 1, 3), at(2025, 1, 3))),
        (dict(), (None, None)),
        (dict(date="2025-01-02", hour="2025-12-30T08", year="2024", hours_lookback=1), (at(2025, 1, 2), at(2025, 1, 3))),
        (dict(date="", week="2025-W01", month="2025-12", year="2024"), (at(2024, 12, 30), at(2025, 1, 6))),
        (dict(year="2024", days_lookback=1, hours_lookback=-1), (at(2024, 1, 1), at(2025, 1, 1))),
        (dict(hours_lookback=1, since="x", as_of=at(2025, 1, 3)), (at(2025, 1, 2, 23), at(2025, 1, 3))),
    ],
)
def test_windows(selector, want):
    assert ls.resolve_window(**selector) == want


@pytest.mark.parametrize(
    "selector",
    [
        dict(date="30.12.2025"), dict(hour="soon"), dict(week="2025-52"), dict(week="2025-W54"), dict(month="2025-13"), dict(month="2025"),
        dict(year="25"), dict(days_lookback=1, hours_lookback=1), dict(days_lookback=-1), dict(hours_lookback=-1), dict(since="soon"),
    ],
)
def test_bad_windows(selector):
    with pytest.raises(ValueError):
        ls.resolve_window(**selector)


def numbers(df):
    return sorted(r.line_no for r in df.select("line_no").collect())


def test_window_is_half_open(lines):
    e = ls.parse_entries(lines(*BRACKET, "ERROR without time"))
    assert numbers(ls.filter_window(e, at(2025, 12, 30, 8, 30), at(2025, 12, 30, 10))) == [2, 4]
    assert numbers(ls.filter_window(e, at(2025, 12, 30, 9), timestamp_policy="exclude")) == [2, 3]
    assert numbers(ls.filter_window(e, None, at(2025, 12, 30, 9), timestamp_policy="exclude")) == [1]
    assert numbers(ls.filter_window(e)) == [1, 2, 3, 4]
    assert numbers(ls.filter_window(e, timestamp_policy="exclude")) == [1, 2, 3]
    for low, high in ((at(2025, 1, 2), at(2025, 1, 1)), (at(2025, 1, 1), at(2025, 1, 1))):
        with pytest.raises(ValueError):
            ls.filter_window(e, low, high)
    with pytest.raises(ValueError):
        ls.filter_window(e, timestamp_policy="maybe")


def test_zone_of_naive_times(lines):
    e = ls.parse_entries(lines('{"ts":"2025-07-01T00:30:00"}', '{"ts":"2025-07-01T00:30:00Z"}', "2025-07-01 00:30:00 [INFO] x"))
    window = dict(since=at(2025, 6, 30, 22), until=at(2025, 7, 1))
    assert numbers(ls.filter_window(e, **window)) == []
    assert numbers(ls.filter_window(e, **window, default_tz="Europe/Berlin")) == [1]
    assert numbers(ls.filter_window(e, datetime(2025, 7, 1), datetime(2025, 7, 1, 1), default_tz="Europe/Berlin")) == [1]


def test_levels(lines):
    e = ls.parse_entries(lines(*BRACKET, "x [NOTICE] y"))
    assert numbers(ls.filter_levels(e, None)) == [1, 2, 3, 4]
    assert numbers(ls.filter_levels(e, [])) == []
    assert numbers(ls.filter_levels(e, ["ERROR", "UNKNOWN"])) == [3, 4]


def test_level_names():
    assert ls.parse_levels([" error", "Warning ", ""]) == ["ERROR", "WARNING"]
    assert ls.parse_levels(["unknown"]) == ["UNKNOWN"]
    assert ls.parse_levels(["", " "]) is None and ls.parse_levels(None) is None and ls.parse_levels([]) is None
    with pytest.raises(ValueError):
        ls.parse_levels(["not-a-level"])
    assert set(ls.effective_levels()) == {"WARNING", "ERROR"}
    assert set(ls.effective_levels(with_review=True)) == {"WARNING", "ERROR", "CRITICAL"}
    assert set(ls.effective_levels(["info"], include_all_levels=True)) == {"DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"}
    assert ls.effective_levels([" "]) is None
    with pytest.raises(ValueError):
        ls.effective_levels(include_all_levels=True, with_review=True)


def test_contains_is_literal(lines):
    df = lines("a.b", "axb", "A.B", "100% a_b")
    assert numbers(ls.filter_contains(df, "a.b")) == [1]
    assert numbers(ls.filter_contains(df, "% a_")) == [4]
    assert numbers(ls.filter_contains(df, None)) == [1, 2, 3, 4]


def test_excluded_lines(spark, lines):
    e = ls.parse_entries(lines(*BRACKET))
    assert numbers(ls.exclude_lines(e, {1, 3})) == [2]
    assert numbers(ls.exclude_lines(e, set())) == [1, 2, 3]
    table = spark.createDataFrame([("f", 2), ("g", 3)], "file string, line_no bigint")
    assert numbers(ls.exclude_lines(e, table)) == [1, 3]


def test_payload(lines):
    e = ls.parse_entries(
        lines(BRACKET[2], "ts=2025-12-30T08:12:04.5 msg=é\"\\\"\" b=1", "WARN x", "2025-12-30T08:00:00Z [INFO] tab\there"),
        ["bracket", "logfmt", "loose"],
    )
    got = [r.payload for r in ls.in_line_order(ls.to_payload(e)).collect()]
    assert got == [
        '{"timestamp":"2025-12-30T10:00:00+00:00","level":"error","message":"err","line_no":1}',
        '{"timestamp":"2025-12-30T08:12:04.500000","level":"unknown","message":"é\\"","line_no":2,'
        '"meta":{"logfmt":{"ts":"2025-12-30T08:12:04.5","msg":"é\\"","b":"1"}}}',
        '{"timestamp":null,"level":"warning","message":"WARN x","line_no":3}',
        '{"timestamp":"2025-12-30T08:00:00+00:00","level":"info","message":"tab\\there","line_no":4}',
    ]
    raw = ls.to_payload(e.where(F.col("line_no") == 3), include_raw=True).first().payload
    assert raw == '{"timestamp":null,"level":"warning","message":"WARN x","line_no":3,"raw":"WARN x"}'


def test_written_entries_are_in_order(spark, lines, tmp_path):
    e = ls.parse_entries(lines(*[f"2025-12-30 08:00:00 [INFO] {n}" for n in range(500)]).repartition(7))
    ls.write_entries(e, str(tmp_path / "out"))
    import glob
    import json

    rows = [json.loads(x) for f in sorted(glob.glob(str(tmp_path / "out" / "part-*"))) for x in open(f)]
    assert [r["line_no"] for r in rows] == list(range(1, 501))
    assert spark.read.json(str(tmp_path / "out")).count() == 500
