import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark.fixed import REDACTIONS
from logspark.operators import review


def text_lines(n, level="INFO"):
    return [f"2025-12-30 08:{i // 60:02d}:{i % 60:02d} [{level}] m{i}" for i in range(1, n + 1)]


def test_redaction(spark):
    texts = [
        "user@example.com 1.2.3.4 eyJaaaaaaaaaa.bbbbbbbbbb.cccccccccc token=abcdefghijklmnopqrstuvwxyz1234567890",
        "2025-12-30T08:12:04+00:00 at fe80::1 and ::1", "Ünïcode.Name@exämple.org é1.2.3.4", "1.2.3.4.5 999.999.999.999",
        "key_ABCDEFGHIJKLMNOPQRSTUVWXYZ-0123456789é", "eyJshort.a.b none", "",
    ]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = [r.text for r in ls.redact(df).orderBy("n").collect()]
    for text, out in zip(texts, got):
        for pattern, mask in REDACTIONS:
            text = re.sub(pattern, mask, text)
        assert out == text
    assert got[0] == "<REDACTED_EMAIL> <REDACTED_IP> <REDACTED_JWT> token=<REDACTED_TOKEN>"
    assert got[1].startswith("2025-12-30T08<REDACTED_IP>+00:00")


def test_segments(lines):
    texts = text_lines(45)
    texts[1] = texts[1].replace("INFO", "WARNING")
    texts[40] = texts[40].replace("INFO", "ERROR")
    identified, rest = ls.split_entries(ls.parse_entries(lines(*texts)))
    assert sorted(r.line_no for r in identified.collect()) == [2, 41]
    got = ls.segments(rest).orderBy("segment_id").collect()
    assert [(r.segment_id, r.first_line, r.last_line, r.n_lines) for r in got] == [(0, 1, 42, 40), (1, 43, 45, 3)]
    want = "\n".join(f"{n} 2025-12-30T08<REDACTED_IP>+00:00 [INFO] m{n}" for n in (43, 44, 45))
    assert got[1].text == want
    assert got[1].text_sha256 == hashlib.sha256(want.encode()).hexdigest()
    plain = ls.segments(rest, max_lines=10, redacted=False).where("segment_id = 0").first()
    assert plain.text.split("\n")[0] == "1 2025-12-30T08:00:01+00:00 [INFO] m1"
    with pytest.raises(ValueError):
        ls.segments(rest, max_lines=0)


def test_segments_across_line_ranges(spark, lines, monkeypatch):
    """Ranges of 7 line numbers, gaps, and a second file: same segments as counting through."""
    monkeypatch.setattr(review, "RANGE_LINES", 7)
    rows = [(f, n) for f, last in (("a", 500), ("b", 33), ("c", 1)) for n in range(1, last + 1) if (n * 7) % 5 != 3]
    df = spark.createDataFrame(rows, "file string, line_no bigint").select(
        "*", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("boolean").alias("ts_naive"),
        F.lit("INFO").alias("level"), F.concat(F.lit("m"), "line_no").alias("message"),
    ).repartition(5)
    got = {(r.file, r.segment_id): r.text for r in ls.segments(df, max_lines=12).collect()}
    want = {}
    for f in "abc":
        mine = [n for g, n in rows if g == f]
        for s in range(0, len(mine), 12):
            want[f, s // 12] = "\n".join(f"{n} - [INFO] m{n}" for n in mine[s : s + 12])
    assert got == want


def test_counting_reads_no_text(spark, lines, tmp_path):
    _, rest = ls.split_entries(ls.parse_entries(lines(*text_lines(3))))
    rest.write.parquet(str(tmp_path / "entries"))
    df = ls.segments(spark.read.parquet(str(tmp_path / "entries")))
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    read = [x.split("ReadSchema: ")[1] for x in scans]
    assert sorted("message" in x for x in read) == [False, True]


def test_dedup_keeps_the_first(spark):
    rows = [("a", n, f"h{n % 3}") for n in range(300)] + [("b", 7, "h1")]
    df = spark.createDataFrame(rows, "file string, segment_id bigint, text_sha256 string").repartition(6)
    got = sorted((r.file, r.segment_id, r.text_sha256) for r in ls.dedup_segments(df).collect())
    assert got == [("a", 0, "h0"), ("a", 1, "h1"), ("a", 2, "h2"), ("b", 7, "h1")]


def test_prompt(lines):
    _, rest = ls.split_entries(ls.parse_entries(lines("x [INFO] a", "x [WARNING] b")))
    prompt = ls.prompts(ls.segments(rest), ["WARNING", "ERROR"]).first().prompt
    assert "so not shown: ERROR, WARNING." in prompt and prompt.endswith("LOG LINES:\n1 - [INFO] a\n")
    assert "[WARNING]" not in prompt


GOOD = {"line_numbers": [1, 2], "severity_guess": "low", "confidence": 0.55, "title": "t", "rationale": "r", "recommendation": "c"}


@pytest.mark.parametrize(
    "change,valid",
    [
        ({}, True), ({"confidence": 1}, True), ({"confidence": 0}, True), ({"line_numbers": []}, True), ({"more": 1}, True),
        ({"confidence": "0.6"}, True), ({"line_numbers": [1.0]}, True),
        ({"confidence": 1.01}, False), ({"confidence": -0.1}, False), ({"confidence": None}, False), ({"severity_guess": "huge"}, False),
        ({"title": 5}, False), ({"title": None}, False), ({"rationale": ["x"]}, False), ({"line_numbers": [1.5]}, False),
        ({"line_numbers": ["x"]}, False), ({"line_numbers": [None]}, False), ({"line_numbers": 3}, False), ({"recommendation": ...}, False),
    ],
)
def test_finding_check(spark, change, valid):
    finding = {k: v for k, v in {**GOOD, **change}.items() if v is not ...}
    df = spark.createDataFrame([("f", 0, json.dumps({"findings": [GOOD, finding]}))], "file string, segment_id bigint, response string")
    row = ls.parse_findings(df).first()
    assert row.valid is valid and (row.findings is not None) is valid


def test_findings(spark):
    low = {**GOOD, "confidence": 0.5499}
    rows = [
        ("f", 0, json.dumps({"findings": [low, GOOD]})), ("f", 1, "{}"), ("f", 2, '{"findings":[]}'), ("f", 3, "[]"), ("f", 4, "no"),
        ("f", 5, '{"findings":null}'), ("f", 6, '{"findings":{}}'), ("f", 7, '{"findings":[1]}'), ("f", 8, None),
    ]
    df = spark.createDataFrame(rows, "file string, segment_id bigint, response string")
    parsed = ls.parse_findings(df)
    assert {r.segment_id: r.valid for r in parsed.collect()} == {n: n < 3 for n in range(9)}
    kept = ls.keep_findings(parsed).collect()
    assert [(r.segment_id, r.pos, r.line_numbers, r.confidence) for r in kept] == [(0, 1, [1, 2], 0.55)]
    assert ls.keep_findings(parsed, min_confidence=0.1).count() == 2
    assert sorted(r.segment_id for r in ls.rejected(df, parsed).collect()) == [3, 4, 5, 6, 7, 8]


def test_review_calls_are_bounded(spark):
    df = spark.createDataFrame([("f", n, f"p{n}") for n in range(20)], "file string, segment_id bigint, prompt string")
    out = ls.review_segments(df, lambda prompt: prompt.upper(), concurrency=2)
    assert out.rdd.getNumPartitions() == 2
    assert {r.segment_id: r.response for r in out.collect()} == {n: f"P{n}" for n in range(20)}
    with pytest.raises(ValueError):
        ls.review_segments(df, str, concurrency=0)
