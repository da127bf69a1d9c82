from datetime import UTC, datetime

import pytest

import logspark as ls

AS_OF = datetime(2025, 12, 31, tzinfo=UTC)
T = datetime(2025, 12, 30, 8, 12, 4)


def parse(df, *args, **kwargs):
    kwargs.setdefault("as_of", AS_OF)
    return {r.line_no: r for r in ls.parse_entries(df, *args, **kwargs).collect()}


LINES = [
    ("2025-12-30 08:12:04 [ERROR] boom", "bracket", T, "ERROR", "boom"),
    ('{"timestamp":"2025-12-30T08:12:04Z","level":"error","message":"boom"}', "jsonl", T, "ERROR", "boom"),
    ('time=2025-12-30T08:12:04Z level=error msg="boom happened"', "logfmt", T, "ERROR", "boom happened"),
    ("time:2025-12-30T08:12:04Z\tlevel:warning\tmsg:slow", "ltsv", T, "WARNING", "slow"),
    ("CEF:0|Security|ThreatManager|1.0|100|Login failed|8|src=1.2.3.4 rt=1735560000000 msg=bad_password",
     "cef", datetime(2024, 12, 30, 12), "ERROR", "bad_password"),
    ("<34>1 2025-12-30T08:12:04Z host app 123 - - hello world", "syslog", T, "CRITICAL", "host app: hello world"),
    ("<34>Dec 29 10:06:00 myhost sshd: failure from=10.0.0.5", "syslog", datetime(2025, 12, 29, 10, 6), "CRITICAL",
     "myhost sshd: failure from=10.0.0.5"),
    ('127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 404 2326', "access",
     datetime(2000, 10, 10, 20, 55, 36), "WARNING", '127.0.0.1 "GET / HTTP/1.0" -> 404 (2326 bytes)'),
    ("WARN something happened", "loose", None, "WARNING", "WARN something happened"),
    # Consequences of the chain order.
    ('{"a":1,"message":"x [INFO] y"}', "bracket", None, "INFO", 'y"}'),
    ("ERROR job=7 failed", "logfmt", None, "UNKNOWN", "ERROR job=7 failed"),
    ("don't ERROR a=1", "loose", None, "ERROR", "don't ERROR a=1"),
    ("information desk", "loose", None, "INFO", "information desk"),
    ("nothing to see", None, None, None, None),
    ("", None, None, None, None),
    # Bracket: exact names only, a failed time does not reject.
    ("soon [warn]  x ", "bracket", None, "UNKNOWN", "x"),
    ("  30-12-2025 08:12:04 [Info] a", "bracket", T, "INFO", "a"),
    ("2025/12/30 8:12:4 [DEBUG] ", "bracket", T, "DEBUG", ""),
    ("2025-13-30 08:12:04 [ERROR] x", "bracket", None, "ERROR", "x"),
    ("2025-12-30T08:12:04Z [CRITICAL] db [x] y", "bracket", T, "CRITICAL", "db [x] y"),
    # JSON: the first present key counts, null included; strings only for time and level.
    ('{"timestamp":null,"ts":"2025-12-30T08:12:04Z","level":3,"severity":"error","msg":null}', "jsonl", None, "UNKNOWN",
     '{"timestamp":null,"ts":"2025-12-30T08:12:04Z","level":3,"severity":"error","msg":null}'),
    (' {"ts":"2025-12-30T09:42:04+01:30","lvl":"Warning","detail":5} ', "jsonl", T, "WARNING", "5"),
    ('{"level":"warn","error":true}', "jsonl", None, "UNKNOWN", "True"),
    ('{"message":"a","message":"b"}', "jsonl", None, "UNKNOWN", "b"),
    ('{"message":""}', "jsonl", None, "UNKNOWN", ""),
    ('{"a":1} {"b":2}', None, None, None, None),
    ('{"a":1},{"b":2}', None, None, None, None),
    ('{"msg":1.5}', "jsonl", None, "UNKNOWN", "1.5"),
    # CEF.
    ("CEF:0|a|b|c|d|e|High", "cef", None, "UNKNOWN", "e"),
    ("CEF:0|a|b|c|d||3|severity=ERROR time=2025-12-30T08:12:04 rt=1 detail=x=y", "cef", T, "INFO", "x=y"),
    ("CEF:0|a|b|c|d||10|=v nothing", "cef", None, "CRITICAL", "CEF:0|a|b|c|d||10|=v nothing"),
    ("CEF:0|a|b|c|d|n| 07 |rt=99999999999999999999", "cef", None, "ERROR", "n"),
    ("CEF:0|a|b|c", None, None, None, None),
    (" CEF:0|a|b|c|d|e|5", None, None, None, None),
    # Key/value lines.
    ("Level=warn level=err LEVEL=Fatal", "logfmt", None, "CRITICAL", "Level=warn level=err LEVEL=Fatal"),
    ("level=none severity=crit msg= error=e1", "logfmt", None, "CRITICAL", "e1"),
    ("time=bad ts=2025-12-30T08:12:04Z a=b", "logfmt", T, "UNKNOWN", "time=bad ts=2025-12-30T08:12:04Z a=b"),
    ("@timestamp=20251230T081204Z =x y", "logfmt", T, "UNKNOWN", "@timestamp=20251230T081204Z =x y"),
    (r'''msg="say \"hi\" \n" k='a b'c\ d''', "logfmt", None, "UNKNOWN", r'say "hi" \n'),
    ('msg="open', None, None, None, None),
    ("a b\tc:d\t:e\tlvl: warn ", "ltsv", None, "WARNING", "a b\tc:d\t:e\tlvl: warn"),
    # Syslog.
    ("<0>1 - h a p m [x y] text ", "syslog", None, "CRITICAL", "h a: text"),
    ("<191>1 2025-12-30T08:12:04.25+00:00 h a p m", "syslog", T.replace(microsecond=250000), "DEBUG", "h a"),
    ("<13>Feb 29 00:00:00 h t: x", "syslog", None, "INFO", "h t: x"),
    ("<11>Jan  2 01:02:03 h  tag [5] : x", "syslog", datetime(2025, 1, 2, 1, 2, 3), "ERROR", "h tag [5]: x"),
    ("<12>Foo 12 01:02:03 h t:", "syslog", None, "WARNING", "h t"),
    # Access.
    ('::1 - u [1/jan/2026:1:2:3 +0000] "x" 500 -', "access", datetime(2026, 1, 1, 1, 2, 3), "ERROR", '::1 "x" -> 500'),
    ('h - - [bad] "x y" 200 007 "r" "ua" more', "access", None, "INFO", 'h "x y" -> 200 (7 bytes)'),
    ('h - - [01/Jan/2026:00:00:00 -07:00] "x" 301 abc', "access", datetime(2026, 1, 1, 7), "INFO", 'h "x" -> 301'),
]


def test_lines(lines):
    got = parse(lines(*[row[0] for row in LINES]))
    for n, (text, fmt, ts, level, message) in enumerate(LINES, 1):
        entry = got.get(n)
        if fmt is None:
            assert entry is None, text
            continue
        assert entry is not None, text
        assert (entry.fmt, entry.ts, entry.level, entry.message, entry.raw) == (fmt, ts, level, message, text)


def test_naive_times(lines):
    texts = ["2025-12-30 08:12:04 [INFO] x", '{"ts":"2025-12-30T08:12:04"}', "ts=2025-12-30T08:12:04Z",
             "ts=x time=y timestamp=z @timestamp=2025-12-30", "WARN"]
    got = parse(lines(*texts))
    assert [got[n].ts_naive for n in range(1, 6)] == [False, True, False, True, None]


def test_year_of_short_syslog_times(lines):
    texts = ["<34>Dec 31 23:00:00 h t: a", "<34>Jan  2 00:00:00 h t: b", "<34>Jan  3 00:00:00 h t: c"]
    got = parse(lines(*texts), as_of=datetime(2026, 1, 1, 12, tzinfo=UTC))
    assert [got[n].ts for n in (1, 2, 3)] == [datetime(2025, 12, 31, 23), datetime(2026, 1, 2), datetime(2025, 1, 3)]


def test_meta(lines):
    got = parse(lines(
        "<165>1 - host app p m - x", "CEF:0|v|p|1|s|n|3|a=1 b=2=3 a=4", "b=1 a=2 b=3", "b:1\ta:2:3", "x [INFO] y"
    ))
    assert got[1].meta.syslog.asDict() == {"pri": 165, "severity": 5, "facility": 20, "host": "host", "app": "app"}
    cef = got[2].meta.cef.asDict()
    assert cef.pop("extension") == {"a": "4", "b": "2=3"}
    assert list(cef.values()) == ["0", "v", "p", "1", "s", "n", "3"]
    assert got[3].meta.logfmt == {"b": "3", "a": "2"}
    assert got[4].meta.ltsv == {"b": "1", "a": "2:3"}
    assert got[5].meta is None


def test_formats_can_be_narrowed_and_reordered(lines):
    df = lines('{"level":"error","message":"boom"}', "x [INFO] ERROR a=1")
    assert {n: r.fmt for n, r in parse(df, ["jsonl", "loose"]).items()} == {1: "jsonl", 2: "loose"}
    assert {n: r.fmt for n, r in parse(df, ["logfmt", "bracket"]).items()} == {2: "logfmt"}
    with pytest.raises(ValueError):
        ls.parse_entries(df, ["xml"])


def test_tables_can_be_changed(lines):
    df = lines("mayday now", "31.12.2025 10:00 [INFO] x", '{"when":"2025-12-30","sev":"error","txt":"m"}', "w=2025-12-30 s=err t=m")
    got = parse(
        df, keywords={"CRITICAL": ["MAYDAY"]}, bracket_formats=["%d.%m.%Y %H:%M"], json_time_keys=["when"],
        json_level_keys=["sev"], json_message_keys=["txt"], kv_time_keys=["w"], kv_level_keys=["s"], kv_message_keys=["t"],
    )
    assert (got[1].fmt, got[1].level) == ("loose", "CRITICAL")
    assert got[2].ts == datetime(2025, 12, 31, 10)
    for n in (3, 4):
        assert (got[n].ts, got[n].level, got[n].message) == (datetime(2025, 12, 30), "ERROR", "m")


def test_user_parser_alone_and_in_a_chain(spark, lines):
    def svc(line_no, line):
        if not line.startswith("svc "):
            return None
        return {"level": "ERROR", "message": line[4:], "ts": datetime(2025, 1, 1, line_no)}

    df = lines("svc a=1", "x [INFO] y", "svc [INFO] z", "a=2", "none")
    alone = {r.line_no: (r.fmt, r.level, r.message, r.ts, r.ts_naive) for r in ls.parse_with(df, svc).collect()}
    assert alone == {
        1: ("svc", "ERROR", "a=1", datetime(2025, 1, 1, 1), True), 3: ("svc", "ERROR", "[INFO] z", datetime(2025, 1, 1, 3), True),
    }
    mixed = {n: (r.fmt, r.message) for n, r in parse(df, ["bracket", svc, "logfmt"]).items()}
    assert mixed == {1: ("svc", "a=1"), 2: ("bracket", "y"), 3: ("bracket", "z"), 4: ("logfmt", "a=2")}
    first = {n: r.fmt for n, r in parse(df, [svc, "bracket"]).items()}
    assert first == {1: "svc", 2: "bracket", 3: "svc"}


def test_unparsed_hits_keep_their_level(lines):
    from pyspark.sql import functions as F

    df = lines("disk SEVERE wear ", "x [INFO] y", "plain").withColumn(
        "hit", F.when(F.col("line_no") < 3, F.lit("CRITICAL"))
    )
    got = parse(df, hit_level="hit")
    assert [(n, got[n].fmt, got[n].level, got[n].message) for n in sorted(got)] == [
        (1, None, "CRITICAL", "disk SEVERE wear"), (2, "bracket", "INFO", "y"),
    ]


def test_filters_do_not_repeat_the_parse(lines):
    """A filter on the level or time stays above the fences; one on the file moves below them."""
    e = ls.parse_entries(lines("x [INFO] y"), as_of=AS_OF).where("level = 'INFO' AND ts IS NOT NULL AND file = 'f'")
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rfc5424\n") <= 2 and plan.count("Generate") == 2
    assert plan.rindex("file#") > plan.rindex("Generate")
