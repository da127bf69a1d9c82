import gzip
import os

import pytest

import logspark as ls
from logspark.operators import sniff

ACCESS = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /" {} 10'
SYSLOG = "<{}>1 2025-12-30T08:12:04Z host app 1 - - msg"


def detected(df, **options):
    return [r.detected for r in ls.sniff_formats(df, **options).collect()]


@pytest.mark.parametrize(
    "text,name",
    [
        (ACCESS.format(404), "access"), (SYSLOG.format(34), "syslog"), ('{"level":"error"}', "jsonl"),
        ("2025-12-30 08:12:04 [ERROR] boom", "bracket"), ("x [ warn ] y", "bracket"), ("just text", "unknown"),
        ("  " + ACCESS.format(200) + " \t", "access"), (" <1> [INFO]", "syslog"),
    ],
)
def test_formats(lines, text, name):
    assert detected(lines(*[text] * 3), sample_lines=10) == [name]
    assert detected(lines(*[text] * 2), sample_lines=10) == ["unknown"]


def test_threshold_and_sample(lines):
    text = "x [INFO] y"
    assert detected(lines(*[text] * 11)) == ["unknown"]
    assert detected(lines(*[text] * 12)) == ["bracket"]
    # Blank lines use up the sample, later lines do not count.
    assert detected(lines(*[""] * 8, *[text] * 3), sample_lines=10) == ["unknown"]
    assert detected(lines(*[""] * 7, *[text] * 3), sample_lines=10) == ["bracket"]


def test_priority(lines):
    both = SYSLOG.format(1) + " [INFO]"
    assert detected(lines(*["{[INFO]}"] * 3), sample_lines=10) == ["jsonl"]
    assert detected(lines(*[both] * 3, *[ACCESS.format(200)] * 3), sample_lines=10) == ["access"]


def test_long_lines_are_cut(lines):
    text = "{" + "é" * 3000 + "}"
    assert detected(lines(*[text] * 3), sample_lines=10) == ["unknown"]
    assert detected(lines(*[text] * 3), sample_lines=10, max_bytes_per_line=7000) == ["jsonl"]


def test_gzip_is_unknown(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.GZ", "wt") as out:
        out.write("x [INFO] y\n" * 50)
    assert detected(ls.read_lines(spark, str(tmp_path))) == ["unknown"]


def hits(df, name, **options):
    return {r.line_no: r.hit_level for r in ls.scan_hits(df, name, **options).collect()}


def test_access_hits(lines):
    df = lines(*[ACCESS.format(s) for s in (200, 404, 500, 301, 599, 600, 499)], "  at stack.trace [ERROR]")
    assert hits(df, "access") == {2: "WARNING", 3: "ERROR", 5: "ERROR", 7: "WARNING"}


def test_syslog_hits(lines):
    df = lines(*[SYSLOG.format(p) for p in (11, 14, 12, 10, 0, 191, 999)], "no pri")
    assert hits(df, "syslog") == {1: "ERROR", 3: "WARNING", 4: "CRITICAL", 5: "CRITICAL"}


def test_token_hits(lines):
    df = lines(
        "INFO ok", "foo ERROR failure", "x [info] [error]", "call failed", "a warn ", "a warn b", '{"a":1,"level":"error"}',
        '{"a":1, "level":"error"}', '{"level": "error"}', "x [WARN] y", "ﬁ ſevere ", "a ınfo b", "x Trace y", "t level=WARNING",
    )
    assert hits(df, "unknown") == {
        2: "ERROR", 3: "ERROR", 4: "ERROR", 5: "WARNING", 6: "WARNING", 8: "ERROR", 13: "DEBUG", 14: "WARNING",
    }
    assert hits(df, "bracket", tokens={"DEBUG": [" ok"]}, case_insensitive=False) == {1: "DEBUG"}


def test_hits_per_detected_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(ACCESS.format(200 + 100 * (n % 4)) for n in range(20)))
    (tmp_path / "b.log").write_text("\n".join(["x [INFO] y"] * 12 + ["x [INF] y", "plain"]))
    (tmp_path / "c.log").write_text("\n".join(["a ERROR b", "plain"]))
    df = ls.read_lines(spark, str(tmp_path))
    count = lambda d: {r.file[-5:]: r["count"] for r in d.groupBy("file").count().collect()}
    assert count(ls.scan_hits(df)) == {"a.log": 10, "b.log": 12, "c.log": 1}
    assert count(ls.scan_hits(df, pass_unknown=True)) == {"a.log": 10, "b.log": 12, "c.log": 2}
    with pytest.raises(ValueError):
        ls.scan_hits(df, "xml")


def _read_bytes(spark):
    """Bytes that this JVM has read from local files so far."""
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in statistics if s.getScheme() == "file")


def test_formats_found_while_counting_are_those_of_a_scan(spark, write):
    texts = {
        "a.log": [ACCESS.format(404)] * 300, "b.log": ["x [INFO] y"] * 11 + ["plain"] * 400, "c.log": ["x [INFO] y"] * 12,
        "d.log": [SYSLOG.format(34)] * 12 + ["é" * 5000] * 30, "e.log": ["plain"] * 120 + ['{"a":1}'] * 50,
    }
    paths = [write(*lines, name=name) for name, lines in texts.items()] + [write(name="f.log", data=b"")]
    paths.append(write(name="g.log.gz", data=gzip.compress(b"x [INFO] y\n" * 50)))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    try:
        # Splits of many, some and no files; at the least, first splits have fewer lines than the sample.
        for size, options in (("128m", {"encoding": "latin-1"}), ("40k", {"allowed_only": True}), ("16k", {})):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines, found = ls.read_and_sniff(spark, paths, **options)
            whole = ls.read_lines(spark, paths, **options)
            assert rows(found) == rows(ls.sniff_formats(whole))
            assert [name for _, name in rows(found)] == ["access", "unknown", "bracket", "syslog", "unknown", "unknown"]
            assert rows(lines) == rows(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wide = write(name="w.log", data=("x [INFO] y\n" * 12).encode("utf-16-le"))
    assert [r.detected for r in ls.read_and_sniff(spark, wide, encoding="utf-16-le")[1].collect()] == ["bracket"]
    assert rows(ls.read_and_sniff(spark, paths[5])[1]) == []


def test_a_large_file_is_read_once_for_number_and_format(spark, write):
    large = write(*["x [INFO] some words to fill the line"] * 400_000, name="large.log")
    small = write(*["plain"] * 200, name="small.log")
    size = os.path.getsize(large)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        before = _read_bytes(spark)
        lines, found = ls.read_and_sniff(spark, [large, small])
        assert sorted(r.detected for r in found.collect()) == ["bracket", "unknown"]
        assert _read_bytes(spark) - before < 1.4 * size
        assert lines.count() == 400_200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_small_files_are_read_once_for_number_and_format(spark, write, monkeypatch):
    heads = {"unknown": "plain words without any sign", "bracket": "x [INFO] some words", "access": ACCESS.format(404), "jsonl": '{"a": 1}'}
    names = list(heads)
    paths = [write(*[heads[names[i % 4]]] * (12 + i), *["other"] * 600, name=f"{i:03d}.log") for i in range(60)]
    size = sum(map(os.path.getsize, paths))
    ways = []
    # Looked at while they are counted; read again; one of the two for each half of the files.
    for limit in (sniff.SMALL_FILE, 0, sorted(map(os.path.getsize, paths))[30]):
        monkeypatch.setattr(sniff, "SMALL_FILE", limit)
        before = _read_bytes(spark)
        lines, found = ls.read_and_sniff(spark, paths)
        ways.append((_read_bytes(spark) - before) / size)
        assert [r.detected for r in found.orderBy("file").collect()] == [names[i % 4] for i in range(60)]
    assert lines.count() == sum(612 + i for i in range(60))
    assert ways[0] < 1.2 < ways[1]


def test_files_that_a_table_does_not_name_are_unknown(spark, lines, monkeypatch):
    from logspark import session

    found = lines("x [INFO] y", "plain", file="a").unionByName(lines("<11>1 z", "<14>1 z", file="b"))
    table = spark.createDataFrame([("b", "syslog")], "file string, detected string")
    for limit in (session.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(session, "MAX_BROADCAST_BYTES", limit)
        got = sorted((r.file, r.line_no) for r in ls.scan_hits(found, table, pass_unknown=True).collect())
        assert got == [("a", 1), ("a", 2), ("b", 1)]
