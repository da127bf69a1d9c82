import gzip
from datetime import UTC, datetime

import pytest

import logspark as ls
from logspark import session

ISO = [
    "2025-12-30T08:12:01Z [INFO] service started", "2025-12-30T08:12:03Z [WARNING] retrying request id=abc123",
    "2025-12-30T08:12:04Z [ERROR] upstream timeout route=/api/v1/items", "2025-12-30T08:12:05Z [CRITICAL] database unavailable",
]


def numbers(df):
    return sorted(r.line_no for r in df.collect())


def test_triage_levels_and_text(spark, write):
    path = write(*ISO)
    out = ls.triage(spark, path, date="2025-12-30", levels=["error", "critical"], contains="route=").collect()
    assert [(r.line_no, r.level, r.message) for r in out] == [(3, "ERROR", "upstream timeout route=/api/v1/items")]
    assert "raw" not in out[0]
    assert ls.triage(spark, path, date="2025-12-30", include_raw=True).columns.count("raw") == 1
    assert numbers(ls.triage(spark, path, date="2025-12-30")) == [2, 3]
    assert numbers(ls.triage(spark, path, date="2025-12-30", levels=["error"], include_all_levels=True)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ls.triage(spark, path, levels=["not-a-level"])
    with pytest.raises(ValueError):
        ls.triage(spark, path, include_all_levels=True, include_review=True)
    with pytest.raises(ValueError):
        ls.triage(spark, path, hours_lookback=0)


def test_default_window_is_a_day(spark, write):
    path = write(*ISO)
    assert numbers(ls.triage(spark, path, as_of=datetime(2025, 12, 31, 8, 12, 4, tzinfo=UTC))) == [3]
    assert numbers(ls.triage(spark, path, hours_lookback=48, as_of=datetime(2025, 12, 31, 8, 12, 4, tzinfo=UTC))) == [2, 3]
    assert numbers(ls.triage(spark, path)) == []


def test_year_edges(spark, write):
    path = write(
        "2024-12-31T23:59:59Z [ERROR] a", "2025-01-01T00:00:00Z [ERROR] b", "2025-12-31T23:59:59Z [ERROR] c", "2026-01-01T00:00:00Z [ERROR] d"
    )
    assert numbers(ls.triage(spark, path, year="2025", include_all_levels=True)) == [2, 3]


def test_prefilter_changes_what_is_seen(spark, write):
    jsonl = [f'{{"level":"error","n":{n}}}' for n in range(15)] + ['{"n":1, "level":"error"}', '{"n":2, "level":"info"}']
    lines = ls.read_lines(spark, write(*jsonl))
    all_time = dict(hours_lookback=None)
    assert numbers(ls.entries(lines, **all_time)) == [16, 17]
    assert len(numbers(ls.entries(lines, fast_prefilter=False, **all_time))) == 17
    assert numbers(ls.entries(lines, severities=["ERROR"], **all_time)) == [16]
    assert numbers(ls.entries(lines, severities=[], **all_time)) == []
    # A file that is not recognised is parsed in full.
    assert len(numbers(ls.entries(lines, sniff_lines=1000, **all_time))) == 17
    assert len(numbers(ls.entries(lines, detected="unknown", **all_time))) == 17


def test_fallback_entries(spark, write):
    lines = ls.read_lines(spark, write(*["x [INFO] y"] * 12, " disk SEVERE wear ", "plain"))
    got = {r.line_no: (r.fmt, r.level, r.message, r.raw) for r in ls.entries(lines, hours_lookback=None).collect()}
    assert len(got) == 13 and got[13] == (None, "CRITICAL", "disk SEVERE wear", " disk SEVERE wear ")


def test_entries_arguments(spark, write):
    lines = ls.read_lines(spark, write(*ISO))
    with pytest.raises(ValueError):
        ls.entries(lines, since=datetime(2025, 1, 1), hours_lookback=24)
    with pytest.raises(ValueError):
        ls.entries(lines, hours_lookback=-1)
    got = ls.entries(lines, since=datetime(2025, 12, 30, 8, 12, 3), hours_lookback=None, include_raw=False)
    assert numbers(got) == [2, 3, 4] and "raw" not in got.columns


def test_gzip_gives_the_same(spark, tmp_path, write):
    plain = write(*ISO)
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write("\n".join(ISO))
    rows = lambda p: [r[1:] for r in ls.triage(spark, p, year="2025").orderBy("line_no").collect()]
    assert rows(plain) == rows(str(tmp_path / "b.log.gz")) != []


def test_review_dataset(spark, write):
    lines = ls.read_lines(spark, write("2025-12-30 08:00:00 [INFO] ok", "2025-12-30 09:00:00 [WARNING] warn", "2025-12-30 10:00:00 [INFO] still"))
    row = ls.review_dataset(lines).first()
    assert (row.first_line, row.last_line, row.n_lines) == (1, 3, 2) and "[WARNING]" not in row.prompt
    assert ls.review_dataset(lines, exclude={1, 3}).count() == 0
    assert ls.review_dataset(lines, identified_levels=["ERROR"]).first().n_lines == 2  # WARNING is in neither set


def test_triage_with_review(spark, write):
    def reviewer(prompt):
        import json

        first = int(prompt.split("LOG LINES:\n")[1].split(" ")[0])
        finding = {"line_numbers": [first], "severity_guess": "low", "confidence": 0.6, "title": "t", "rationale": "r", "recommendation": "c"}
        return json.dumps({"findings": [finding]})

    path = write(*ISO)
    out = ls.triage(spark, path, date="2025-12-30", include_review=True, reviewer=reviewer)
    assert numbers(out.identified) == [2, 3, 4]
    assert [r.line_numbers for r in out.findings.collect()] == [[1]]
    assert out.rejected.count() == 0 and out.segments.count() == 1
    bad = ls.triage(spark, path, date="2025-12-30", include_review=True, reviewer=lambda prompt: "oops")
    assert bad.findings.count() == 0 and bad.rejected.count() == 1
    assert ls.triage(spark, path, date="2025-12-30", include_review=True).findings is None


def test_stream_matches_batch(spark, tmp_path):
    from logspark.streaming.lines import stream_entries, stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(ISO + ["<34>Dec 29 10:06:00 h t: x"]))
    as_of = datetime(2025, 12, 31, tzinfo=UTC)
    e = stream_entries(stream_lines(spark, str(tmp_path / "in")), as_of=as_of, severities=["ERROR", "CRITICAL"])
    q = e.writeStream.format("memory").queryName("out").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted((r.level, r.message) for r in spark.sql("SELECT * FROM out").collect())
    finally:
        q.stop()
    batch = ls.entries(ls.read_lines(spark, str(tmp_path / "in")), as_of=as_of, hours_lookback=None, severities=["ERROR", "CRITICAL"])
    assert got == sorted((r.level, r.message) for r in batch.collect()) and len(got) == 3


def test_intermediate_tables_in_one_folder(spark, tmp_path, monkeypatch):
    """All lie below the application's folder, which one call removes without touching its neighbours."""
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    (tmp_path / "neighbour").mkdir()
    assert session.written_table(spark.range(3).toDF("id"), "three").count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"logspark-{spark.sparkContext.applicationId}", "neighbour"]
    for _ in range(2):
        ls.remove_scratch(spark)
        assert [p.name for p in tmp_path.iterdir()] == ["neighbour"]
