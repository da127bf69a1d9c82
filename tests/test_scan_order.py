"""Order kept without a shuffle: the sink, segments built where entries lie, stored answers, user parsers."""

import hashlib
import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark import session
from logspark.operators import review


@pytest.fixture
def small_splits(spark):
    """Cut files into splits of 2000 bytes, several of them packed into some partitions."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture
def logs(tmp_path):
    """Three files of unlike size; every seventh line is an error, all others go to review."""
    folder, want = tmp_path / "logs", {}
    folder.mkdir()
    for name, count in (("a.log", 700), ("b.log", 41), ("c.log", 300), ("d.log", 1)):
        texts = [f"2025-12-30 08:00:00 [{'ERROR' if n % 7 == 0 else 'INFO'}] {name} step {n} {'x' * (n % 50)}" for n in range(1, count + 1)]
        (folder / name).write_text("\n".join(texts) + "\n")
        want[name] = [t.split("] ")[1].strip() for t in texts]
    return str(folder), want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written_lines(path):
    """What `cat` of all parts in the order of their names shows."""
    parts = sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))
    return [line for p in parts for line in open(p).read().splitlines()]


@pytest.mark.parametrize("way", ["in place", "after a shuffle", "range shuffle"])
def test_sink_keeps_line_order(spark, logs, tmp_path, small_splits, way):
    folder, want = logs
    lines = ls.read_lines(spark, folder, keep_split=way != "range shuffle")
    entries = ls.parse_entries(lines, ["bracket"], carry=[c for c in ("split",) if c in lines.columns])
    if way == "in place":
        assert "Exchange hash" not in plan_of(entries) and "Exchange range" not in plan_of(entries) and session.keeps_scan_order(entries)
    if way == "after a shuffle":
        entries = entries.repartition(5)
        assert not session.keeps_scan_order(entries)
    n = ls.write_entries(ls.to_payload(entries), str(tmp_path / "out"))
    found = [json.loads(line) for line in written_lines(tmp_path / "out")]
    assert n == len(found) == sum(map(len, want.values()))
    assert [(r["message"], r["line_no"]) for r in found] == [(m, i) for name in sorted(want) for i, m in enumerate(want[name], 1)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"
    folders = [f for f in os.listdir(tmp_path / "out") if f.startswith("split=")]
    assert (len(folders) > 20) == (way != "range shuffle")


def test_sink_in_place_stores_nothing_and_moves_nothing(spark, logs, tmp_path, small_splits, monkeypatch):
    made = []
    monkeypatch.setattr("logspark.operators.payload.written_table", lambda df, name: made.append(name))
    found = ls.triage(spark, logs[0], date="2025-12-30", include_all_levels=True, keep_split=True)
    assert found.columns[-1] == "split"
    assert "Exchange" not in plan_of(found).replace("BroadcastExchange", "")
    assert ls.write_entries(found, str(tmp_path / "out"), format="parquet") == found.count() and not made
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.select("file", "line_no", "split", F.col("_metadata.row_index").alias("at")).orderBy("split", "at").collect()
    assert [(r.file, r.line_no) for r in rows] == sorted((r.file, r.line_no) for r in rows)


def test_sink_of_nothing(spark, logs, tmp_path):
    found = ls.triage(spark, logs[0], date="2001-01-01", include_all_levels=True, keep_split=True)
    assert ls.write_entries(found, str(tmp_path / "none")) == 0
    assert ls.entries(ls.read_lines(spark, logs[0], keep_split=True), severities=[]).columns[-1] == "split"


def expected(want, size, redacted=False):
    out = {}
    for name, messages in want.items():
        mine = [(i, m) for i, m in enumerate(messages, 1) if i % 7]
        for s in range(0, len(mine), size):
            out[name, s // size] = "\n".join(f"{i} 2025-12-30T08:00:00+00:00 [INFO] {m}" for i, m in mine[s : s + size])
    return out


@pytest.mark.parametrize("size", [1, 12, 40, 10_000])
def test_segments_in_place(spark, logs, small_splits, size, monkeypatch):
    folder, want = logs
    lines = ls.read_lines(spark, folder, keep_split=True)
    _, rest = ls.split_entries(ls.parse_entries(lines, ["bracket"], carry=["split"]))
    table = ls.stored(rest, "review-entries")
    assert "split" in table.columns
    monkeypatch.setattr(review, "_by_ranges", None)
    got = ls.segments(table, max_lines=size, redacted=False)
    assert {(r.file.rsplit("/", 1)[1], r.segment_id): r.text for r in got.collect()} == expected(want, size)
    for r in got.collect():
        numbers = [int(line.split(" ")[0]) for line in r.text.split("\n")]
        assert (r.first_line, r.last_line, r.n_lines) == (numbers[0], numbers[-1], len(numbers))


def test_only_cut_segments_are_shuffled(spark, logs):
    """The texts that reach the grouping are those of segments a border cuts."""
    folder, _ = logs
    lines = ls.read_lines(spark, folder, keep_split=True)
    _, rest = ls.split_entries(ls.parse_entries(lines, ["bracket"], carry=["split"]))
    got = ls.segments(ls.stored(rest, "review-entries"))
    plan = plan_of(got)
    cut = plan[plan.index("Exchange hashpartitioning") :]
    assert "n_lines" in cut and "size" in cut and plan.count("Exchange hashpartitioning") == 1
    assert got.where("n_lines > 0").count() == len(expected(logs[1], 40))


def test_segments_after_a_shuffle_or_out_of_order(spark, logs, small_splits):
    folder, want = logs
    lines = ls.read_lines(spark, folder, keep_split=True)
    _, rest = ls.split_entries(ls.parse_entries(lines, ["bracket"], carry=["split"]).repartition(4))
    table = ls.stored(rest, "review-entries")
    assert "split" not in table.columns
    key = lambda df: {(r.file.rsplit("/", 1)[1], r.segment_id): r.text for r in df.collect()}
    assert key(ls.segments(table, max_lines=12, redacted=False)) == expected(want, 12)
    # A table that only claims to be in order is noticed by its index.
    mixed = session.written_table(rest, "mixed")
    assert key(ls.segments(mixed, max_lines=12, redacted=False)) == expected(want, 12)


def test_review_of_files_in_place(spark, logs, small_splits, monkeypatch):
    folder, want = logs
    monkeypatch.setattr(review, "_by_ranges", None)
    out = ls.triage(spark, folder, date="2025-12-30", include_review=True)
    assert "split" not in out.identified.columns and out.identified.count() == sum(len(m) // 7 for m in want.values())
    assert out.segments.count() == len(expected(want, 40))
    assert ls.review_dataset(ls.read_lines(spark, folder, keep_split=True), segment_max_lines=9).count() == len(expected(want, 9))


# Stored answers.


@pytest.fixture
def asked(spark):
    rows = [("f", n, f"p{n}", f"h{n}") for n in range(60)] + [("f", 100, "p1", "h1"), ("g", 0, "p1", "h1")]
    return spark.createDataFrame(rows, "file string, segment_id bigint, prompt string, text_sha256 string")


def test_a_killed_job_asks_no_stored_text_again(spark, asked, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()

    def count(prompt):
        with open(calls / prompt, "a") as out:
            out.write("x")
        return prompt.upper()

    def dies(prompt):
        if prompt == "p31":
            os._exit(1)
        return count(prompt)

    with pytest.raises(Exception):  # noqa: B017
        ls.review_segments(asked, dies, answers=answers, batch=5, concurrency=2)
    stored = {r.text_sha256 for r in spark.read.parquet(answers).collect()}
    assert 5 <= len(stored) < 60
    before = {p.name: p.read_text() for p in calls.iterdir()}
    got = {(r.file, r.segment_id): (r.response, r.error) for r in ls.review_segments(asked, count, answers=answers, batch=7).collect()}
    assert got == {(r.file, r.segment_id): (r.prompt.upper(), None) for r in asked.collect()}
    again = {p.name for p in calls.iterdir() if p.read_text() != before.get(p.name, "x")}
    assert not again & {f"p{h[1:]}" for h in stored if h != "h1"}  # the text of h1 stands in two files


def test_failed_calls_are_tried_by_the_next_job(spark, asked, tmp_path):
    answers = str(tmp_path / "answers")

    def odd(prompt):
        if int(prompt[1:]) % 2:
            raise ValueError(prompt)
        return prompt

    first = {(r.file, r.segment_id): (r.response, r.error) for r in ls.review_segments(asked, odd, answers=answers, pause=0).collect()}
    assert first["f", 2] == ("p2", None) and first["g", 0] == (None, "ValueError: p1") and len(first) == 62
    second = ls.review_segments(asked, lambda prompt: "late" if int(prompt[1:]) % 2 else 1 / 0, answers=answers, pause=0).collect()
    assert all(r.error is None and r.response == ("late" if r.segment_id % 2 or r.segment_id == 100 or r.file == "g" else f"p{r.segment_id}") for r in second)
    assert ls.review_segments(asked.limit(0), str, answers=str(tmp_path / "none")).count() == 0


def test_small_batches_are_no_jobs_of_their_own(spark, asked, tmp_path, monkeypatch):
    from logspark.operators import review

    def ask(name, **options):
        sc = spark.sparkContext
        sc.setLocalProperty("spark.jobGroup.id", name)
        try:
            replies = ls.review_segments(asked, str.upper, answers=str(tmp_path / name), **options)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        got = {(r.file, r.segment_id): (r.response, r.error) for r in replies.collect()}
        assert got == {(r.file, r.segment_id): (r.prompt.upper(), None) for r in asked.collect()}
        assert spark.read.parquet(str(tmp_path / name)).count() == 61  # equal texts of a file are sent once
        return len(sc.statusTracker().getJobIdsForGroup(name))

    fewest = ask("one", batch=1000)
    assert ask("small", batch=1) <= fewest + 2
    assert ask("bounded", batch=20, concurrency=2) >= 4
    monkeypatch.setattr(review, "JOB_TASKS", 20)
    monkeypatch.setattr(review, "FILE_PROMPTS", 3)
    assert ask("several", batch=1) <= fewest + 8


def test_a_given_concurrency_bounds_the_calls_at_a_time(spark, asked, tmp_path):
    spans = tmp_path / "spans"
    spans.mkdir()

    def slow(prompt):
        import time
        import uuid

        start = time.time()
        time.sleep(0.02)
        (spans / uuid.uuid4().hex).write_text(f"{start} {time.time()}")
        return prompt

    ls.review_segments(asked, slow, answers=str(tmp_path / "answers"), batch=3, concurrency=2)
    found = [tuple(map(float, p.read_text().split())) for p in spans.iterdir()]
    assert len(found) == 61 and max(sum(a <= start < b for a, b in found) for start, _ in found) <= 2


def test_pauses_between_tries(spark, asked, monkeypatch):
    from logspark import fixed

    monkeypatch.setattr(fixed, "REVIEW_LONGEST_PAUSE", 0.3)

    def slow(prompt):
        import time

        raise RuntimeError(f"{time.time():.3f}")

    import time

    start = time.time()
    out = ls.review_segments(asked.limit(1), slow, retries=3, pause=0.2).first()
    assert float(out.error.split(": ")[1]) - start > 0.2 + 0.3 and out.response is None
    with pytest.raises(ValueError):
        ls.review_segments(asked, slow, pause=-1)


# User parsers.


def test_user_parser_ships_two_columns(spark, lines):
    wide = lines("a=1", "b", "", None).withColumn("split", F.lit(7)).withColumn("more", F.lit("x" * 100))

    def parser(line_no, line):
        if not line:
            return None
        meta = {"syslog": {"pri": 1, "host": "h"}, "logfmt": {"k": "v", "n": None}} if "=" in line else None
        return {"ts": datetime(9999, 12, 31, 23, 59, 59, 999999, tzinfo=UTC), "message": line_no, "meta": meta}

    out = ls.parse_with(wide, parser, fmt="own", carry=["split"])
    plan = plan_of(out)
    assert plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan
    shipped = plan[plan.index("ArrowEvalPython") :].split("\n")[0]
    assert "split" not in shipped.split("]")[0] and "more" not in shipped.split("]")[0]
    rows = sorted(out.collect(), key=lambda r: r.line_no)
    assert [(r.line_no, r.fmt, r.level, r.message, r.raw, r.split) for r in rows] == [(1, "own", "UNKNOWN", "1", "a=1", 7), (2, "own", "UNKNOWN", "2", "b", 7)]
    assert rows[0].meta.logfmt == {"k": "v", "n": None} and rows[0].meta.syslog.pri == 1 and rows[0].meta.syslog.app is None
    assert rows[1].meta is None and rows[0].ts.year == 9999 and rows[0].ts_naive is False
    hits = lines("b", "  c ").withColumn("hit", F.lit("ERROR"))
    kept = ls.parse_with(hits, lambda n, x: None, hit_level="hit").orderBy("line_no").collect()
    assert [(r.fmt, r.level, r.message) for r in kept] == [(None, "ERROR", "b"), (None, "ERROR", "c")]


def test_parser_sees_only_what_is_left(lines, tmp_path):
    def last(line_no, line):
        with open(tmp_path / "seen", "a") as out:
            out.write(f"{line_no} ")
        return {"level": "INFO"}

    out = ls.parse_entries(lines("2025-12-30 08:00:00 [ERROR] a", "plain", '{"level":"info"}'), ["bracket", "jsonl", last])
    assert [(r.line_no, r.fmt) for r in out.orderBy("line_no").collect()] == [(1, "bracket"), (2, "last"), (3, "jsonl")]
    assert set((tmp_path / "seen").read_text().split()) == {"2"}


# Window skipping.


def _read_bytes(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")


@pytest.fixture
def days(tmp_path):
    """One file a day; some have lines without a time, one a line that may hold one."""
    folder = tmp_path / "days"
    folder.mkdir()
    for day in range(1, 13):
        texts = [f"2025-11-{day:02d} {h:02d}:{m:02d}:00 [{'ERROR' if m % 9 == 0 else 'INFO'}] step {m} {'x' * 200}" for h in range(24) for m in range(60)]
        texts[5:5] = ["  at some.place(Some.java)", "plain words"]
        if day == 4:
            texts.append('{"timestamp": "2025-11-09T12:00:00Z", "level": "error", "message": "late"}')
        if day == 6:
            texts = [f"<11>1 2025-11-06T{n % 24:02d}:00:00Z h app 1 - - m{n} {'y' * 200}" for n in range(1500)]
        if day == 7:
            texts = [f"<11>Nov {n % 28 + 1:2d} 10:00:00 h app: m{n} {'y' * 200}" for n in range(1500)]
        (folder / f"{day:02d}.log").write_text("\n".join(texts) + "\n")
    return str(folder)


AS_OF = datetime(2025, 12, 1, tzinfo=UTC)


@pytest.mark.parametrize("window,prefilter", [
    (dict(date="2025-11-09"), True), (dict(since="2025-11-05T20:00:00", until="2025-11-06T02:00:00"), False), (dict(date="2025-12-25"), True),
])
def test_skipping_changes_no_row(spark, days, window, prefilter):
    options = dict(include_all_levels=True, as_of=AS_OF, fast_prefilter=prefilter, default_tz="America/New_York")
    rows = lambda df: sorted((r.file, r.line_no, r.level, r.message) for r in df.collect())
    every = ls.triage(spark, days, timestamp_policy="include", **window, **options)
    want = rows(every.where("ts IS NOT NULL"))
    assert rows(ls.triage(spark, days, timestamp_policy="exclude", **window, **options)) == want
    zones = ls.time_zones(spark, days, default_tz="America/New_York")
    assert rows(ls.triage(spark, days, timestamp_policy="exclude", zones=zones, **window, **options)) == want
    assert bool(want) == (window != dict(date="2025-12-25"))


def test_skipped_files_are_not_read(spark, days):
    size = sum(os.path.getsize(f"{days}/{f}") for f in os.listdir(days))
    options = dict(date="2025-11-09", include_all_levels=True, as_of=AS_OF, fast_prefilter=False)

    def cost(**more):
        before = _read_bytes(spark)
        n = ls.triage(spark, days, **options, **more).where("ts IS NOT NULL").count()
        return n, (_read_bytes(spark) - before) / size

    whole, skipping = cost(), cost(timestamp_policy="exclude")
    zones = ls.time_zones(spark, days).cache()
    assert {r.file[-6:-4] for r in zones.where("open > 0").collect()} == {"04", "07"}
    stored = cost(timestamp_policy="exclude", zones=zones)
    assert whole[0] == skipping[0] == stored[0] == 1440 + 1 + 54
    # Two whole scans; one scan and the open quarter twice; the open quarter thrice.
    assert whole[1] > 1.9 and skipping[1] < 1.7 and stored[1] < 0.9


def test_closed_splits_of_one_file_are_not_parsed(spark, days, tmp_path, small_splits):
    path = tmp_path / "all.log"
    path.write_text("".join(open(f"{days}/{d:02d}.log").read() for d in (1, 2, 3)))
    options = dict(include_all_levels=True, as_of=AS_OF, timestamp_policy="exclude")
    found = ls.triage(spark, str(path), date="2025-11-02", **options)
    assert "LeftAnti" in plan_of(found)
    assert sorted(r.line_no for r in found.collect()) == [n for n in range(1443, 2885) if n not in (1448, 1449)]


def test_other_chains_are_not_skipped(spark, days):
    from logspark.operators.zones import timed_formats

    assert timed_formats(["bracket", "jsonl", "syslog"]) == ["bracket"] and timed_formats(["jsonl", "bracket"]) == []
    assert timed_formats(["bracket", lambda n, x: None]) == []
    zones = ls.time_zones(spark, days, formats=["jsonl", "bracket"])
    assert zones.where("open = 0").count() == 0
    n = ls.triage(spark, days, date="2025-11-09", formats=["jsonl", "bracket"], timestamp_policy="exclude", include_all_levels=True, fast_prefilter=False).count()
    assert n == 1441


# Files that cannot be split.


def test_lines_of_a_gzip_file_are_spread(spark, tmp_path):
    import gzip

    texts = [f"2025-12-30 08:00:00 [INFO] m{n} {hashlib.sha512(str(n).encode()).hexdigest()}" for n in range(60_000)]
    with gzip.open(tmp_path / "a.log.gz", "wt") as out:
        out.write("\n".join(texts))
    (tmp_path / "b.log").write_text("\n".join(texts[:100]))
    lines = ls.read_lines(spark, [str(tmp_path / "a.log.gz"), str(tmp_path / "b.log")])
    assert sorted((r.file[-6:], r.line_no, r.line) for r in lines.collect()) == sorted(
        [("log.gz", i, t) for i, t in enumerate(texts, 1)] + [("/b.log"[-6:], i, t) for i, t in enumerate(texts[:100], 1)]
    )
    tasks = lines.where("file LIKE '%gz'").groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("line")).alias("size")).collect()
    assert len(tasks) > 3 and max(r["size"] for r in tasks) < 0.5 * sum(r["size"] for r in tasks)
    plain = ls.read_lines(spark, str(tmp_path / "b.log"))
    assert "Exchange" not in plan_of(plain).replace("BroadcastExchange", "")
    kept = ls.read_lines(spark, str(tmp_path / "a.log.gz"), keep_split=True)
    assert "Exchange" not in plan_of(kept).replace("BroadcastExchange", "") and kept.count() == 60_000
