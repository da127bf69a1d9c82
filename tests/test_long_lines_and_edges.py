import json
import random
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark import fixed, session
from logspark.operators import parse
from logspark.functions.text import unicode_blanks

AS_OF = datetime(2024, 1, 15, 12, tzinfo=UTC)


def plain_redaction(text):
    for pattern, mask in fixed.REDACTIONS:
        text = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(mask))
    return text


def test_redaction_equals_the_plain_patterns(spark):
    rng = random.Random(12)
    bits = ["a", "B7", ".", "..", "@", "é", "-", "_", "%", "+", " ", "com", "co.uk", "x@y.zz", "eyJ", "eyJabcdefghij", "abcdefghijk", ":", "::1", "1.2.3.4",
            "ſ", "0123456789abcdef0123456789abcdef", "٣", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(100_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert ls.redact(df.withColumn("plain", plain_redaction(F.col("text")))).where("text != plain").limit(3).collect() == []


@pytest.mark.parametrize("bad", ["a.", "a-", "eyJaaaaaaaaaa-", "a@", "a@a.", "1.", "a:", ".", "ab%"])
def test_redaction_of_long_lines(spark, bad):
    df = spark.createDataFrame([(bad * (1_000_000 // len(bad)),)], "text string")
    start = time.time()
    ls.redact(df).agg(F.sum(F.length("text"))).collect()
    assert time.time() - start < 20


@pytest.mark.parametrize(
    "line", [
        " " * 200_000 + "]", "x" + " " * 200_000 + "[", "<34>Mar 1 10:00:00 h" + " " * 200_000, "<34>Mar 1 10:00:00" + " " * 200_000 + "x",
        "<34>Mar" + " " * 200_000, "<34>1 " + " " * 200_000, "1.2.3.4 - - [x] \"" + " " * 200_000, "a b " * 50_000 + "]",
    ],
)
def test_shapes_of_long_lines(spark, lines, line):
    start = time.time()
    ls.parse_entries(lines(line), as_of=AS_OF).collect()
    assert time.time() - start < 20


def test_shapes_equal_the_plain_ones(spark):
    rng = random.Random(7)
    bits = [" ", "  ", "\t", "[", "]", "ERROR", "x", "é", ":", "<34>", "Mar", "1", "10:00:00", "host", "app[3]", " ", "msg"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(30_000)]
    blanks = [" ", "  ", "\t", " "]
    texts += [f"<34>Mar{rng.choice(blanks)}1{rng.choice(blanks)}10:00:00{rng.choice(blanks)}h{rng.choice(blanks)}{''.join(rng.choices(bits, k=4))}" for _ in range(30_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    out = "".join(f"|${i}" for i in range(1, 4))
    for fast, plain, groups in ((parse._BRACKET, fixed.BRACKET, 3), (parse._RFC3164, fixed.RFC3164, 5)):
        put = "".join(f"|${i}" for i in range(1, groups + 1))
        one = F.rtrim(F.regexp_replace("t", F.lit(fast), F.lit(put)), F.lit(" \t "))
        two = F.rtrim(F.regexp_replace("t", F.lit(unicode_blanks(plain)), F.lit(put)), F.lit(" \t "))
        assert df.select("t", one.alias("a"), two.alias("b")).where("a != b").limit(3).collect() == []
    assert out


def test_payload_lines_are_plain_json(spark, lines, tmp_path):
    found = ls.parse_entries(lines("2024-01-02 03:04:05 [ERROR] b \"q\"", "nothing here", "2024-01-02 03:04:06 [INFO] a"), ["bracket"], as_of=AS_OF)
    assert ls.write_entries(ls.to_payload(found), str(tmp_path / "out")) == 2
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [(r["line_no"], r["message"]) for r in rows] == [(1, 'b "q"'), (3, "a")]


def test_no_levels_start_no_job(spark, lines):
    df = lines("2024-01-02 03:04:05 [ERROR] x")
    spark.sparkContext.setJobGroup("none", "none")
    out = ls.entries(df, severities=[], hours_lookback=None, include_raw=False)
    assert "raw" not in out.columns and out.schema["meta"].dataType.fieldNames() == ["syslog", "cef", "logfmt", "ltsv"]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("none")
    assert out.count() == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_formats_join_without_a_key_per_file(spark, lines, monkeypatch):
    df = lines(*["2024-01-02 03:04:05 [ERROR] x"] * 500)
    want = ls.scan_hits(df).count()
    monkeypatch.setattr(session, "MAX_BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = ls.scan_hits(df)
        assert hits.count() == want == 500
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "_copy" in plan and "hashpartitioning(file#" in plan
        assert all("_copy" in p for p in plan.split("hashpartitioning(")[1:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exclusion_below_the_parse(spark, lines):
    df = lines("2024-01-02 03:04:05 [INFO] a", "2024-01-02 03:04:05 [INFO] b", "2024-01-02 03:04:05 [INFO] c")
    out = ls.triage_with_review(df, exclude=[2], as_of=AS_OF)
    assert "2 2024" not in out.segments.first()["text"] and out.segments.first()["n_lines"] == 2
    assert sorted(r["line_no"] for r in ls.exclude_lines(df, iter([1, 3])).collect()) == [2]
    assert ls.exclude_lines(df, []).count() == 3


def test_user_parser_far_dates_and_no_numbers(spark):
    def parser(line_no, line):
        return {"ts": datetime(int(line), 5, 6, 7, 8, 9, 123456), "level": "INFO", "message": f"{line_no}", "meta": None}

    df = spark.createDataFrame([("f", 1, "1500"), ("f", None, "9999"), ("f", 2**60 + 1, "2024")], "file string, line_no bigint, line string")
    rows = {r["raw"]: r for r in ls.parse_with(df, parser).selectExpr("raw", "line_no", "cast(ts AS string) AS ts", "message").collect()}
    assert {k: r["ts"] for k, r in rows.items()} == {k: f"{k}-05-06 07:08:09.123456" for k in ("1500", "9999", "2024")}
    assert rows["9999"]["line_no"] is None and rows["9999"]["message"] == "None"


def test_failed_review_calls_are_set_aside(spark):
    calls = spark.sparkContext.accumulator(0)

    def reviewer(prompt):
        calls.add(1)
        if "bad" in prompt:
            raise RuntimeError("down")
        return '{"findings": []}'

    df = spark.createDataFrame([("f", 0, "good"), ("f", 1, "bad")], "file string, segment_id bigint, prompt string")
    answers = ls.review_segments(df, reviewer, retries=2).collect()
    assert {(r["segment_id"], r["response"] is None, r["error"]) for r in answers} == {(0, False, None), (1, True, "RuntimeError: down")}
    assert calls.value == 4
    answers = spark.createDataFrame(answers, "file string, segment_id bigint, response string, error string")
    assert [r["error"] for r in ls.rejected(answers, ls.parse_findings(answers)).collect()] == ["RuntimeError: down"]


@pytest.mark.parametrize("charset", ["cp1252", "iso-8859-15", "koi8-r", "utf-16-le", "utf-16-be"])
def test_charsets(spark, write, charset):
    text = ["2024-01-02 03:04:05 [ERROR] naïve €" if charset != "koi8-r" else "2024-01-02 03:04:05 [ERROR] Привет", "2024-01-02 03:04:06 [ERROR] two"]
    path = write(data="\n".join(text).encode(charset))
    found = ls.triage(spark, path, date="2024-01-02", encoding=charset, as_of=AS_OF, fast_prefilter=False)
    assert [r["message"] for r in found.orderBy("line_no").collect()] == [t.split("] ")[1] for t in text]


def test_unknown_bytes_and_charsets(spark, write):
    path = write(data=b"a\x81b\n")
    read = lambda errors: [r["line"] for r in ls.read_lines(spark, path, encoding="cp1252", decode_errors=errors).collect()]
    assert read("replace") == ["a�b"] and read("ignore") == ["ab"]
    with pytest.raises(Exception, match="does not know"):
        read("strict")
    for name in ("utf-7", "shift_jis", "none-such"):
        with pytest.raises(ValueError, match="encoding"):
            ls.read_lines(spark, path, encoding=name)
