import gzip

import pytest
from pyspark.sql import functions as F

import logspark as ls


def numbered(df):
    return [(r.line_no, r.line) for r in df.orderBy("file", "line_no").collect()]


@pytest.fixture
def small_splits(spark):
    """Cut files into splits of 2000 bytes, several of them packed into some partitions."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "2000")
    spark.conf.set(names[1], "10")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_newlines_and_numbers(spark, write):
    path = write(data=b"a\r\nb\rc\n\n d \nlast")
    assert numbered(ls.read_lines(spark, path)) == [(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, " d "), (6, "last")]
    kept = ls.read_lines(spark, path, line_sep="\n")
    assert numbered(kept) == [(1, "a"), (2, "b\rc"), (3, ""), (4, " d "), (5, "last")]


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    want = {}
    for name, count, width in (("a.log", 1500, 30), ("b.log", 700, 90), ("c.log", 3, 5), ("d.log", 40, 400), ("e.log", 25, 9)):
        texts = [f"{name} {n} " + "x" * (n * 7 % width) for n in range(1, count + 1)]
        (tmp_path / name).write_text("\n".join(texts) + "\n")
        want.update({(name, n): t for n, t in enumerate(texts, 1)})
    with gzip.open(tmp_path / "f.log.gz", "wt") as out:
        out.write("\n".join(f"z {n}" for n in range(1, 301)))
    want.update({("f.log.gz", n): f"z {n}" for n in range(1, 301)})
    df = ls.read_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in df.collect()}
    assert got == want


def test_changed_splits_are_an_error(spark, tmp_path, small_splits):
    (tmp_path / "a.log").write_text("\n".join(f"line {n}" for n in range(2000)))
    df = ls.read_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    with pytest.raises(Exception, match="file splits changed"):
        df.collect()


def test_large_lookup_side_is_joined_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    from logspark import session

    (tmp_path / "a.log").write_text("\n".join(f"line {n}" for n in range(2000)))
    monkeypatch.setattr(session, "MAX_BROADCAST_BYTES", 10)
    monkeypatch.setattr("logspark.sources.lines.lookup_side", session.lookup_side)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ls.read_lines(spark, str(tmp_path))
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.line_no: r.line for r in df.collect()} == {n + 1: f"line {n}" for n in range(2000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_filter_on_the_file_keeps_numbers(spark, tmp_path, small_splits):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("\n".join(f"{name} {n}" for n in range(1, 900)))
    df = ls.read_lines(spark, str(tmp_path)).where(F.col("file").endswith("b.log"))
    assert {r.line_no: r.line for r in df.collect()} == {n: f"b.log {n}" for n in range(1, 900)}


@pytest.mark.parametrize("text", [b"ok", b"caf\xc3\xa9", b"\xff a", b"a\xe2\x82", b"x \xef\xbf\xbd y \xc0", b"\xed\xa0\x80z"])
@pytest.mark.parametrize("errors", ["replace", "ignore"])
def test_decoding(spark, write, text, errors):
    got = numbered(ls.read_lines(spark, write(data=text + b"\n"), decode_errors=errors))
    assert got == [(1, text.decode("utf-8", errors))]


def test_strict_decoding_and_charsets(spark, write):
    bad = write(data=b"ok\n\xff\n")
    with pytest.raises(Exception, match="(?i)utf-?8"):
        ls.read_lines(spark, bad, decode_errors="strict").collect()
    assert numbered(ls.read_lines(spark, bad, encoding="latin-1")) == [(1, "ok"), (2, "ÿ")]
    assert numbered(ls.read_lines(spark, bad, encoding="ascii")) == [(1, "ok"), (2, "�")]
    with pytest.raises(ValueError):
        ls.read_lines(spark, bad, encoding="ebcdic")
    with pytest.raises(ValueError):
        ls.read_lines(spark, bad, decode_errors="maybe")


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ls.read_lines(spark, str(tmp_path / "none.log"))


def test_allowed_files_and_whole_texts(spark, tmp_path):
    for name in ("a.log", "b.TXT", "c.md", "d.csv", "e.log.bak"):
        (tmp_path / name).write_bytes(f"{name}\r\n1\r2\n".encode())
    for name in ("g.Log.GZ", "h.csv.gz"):
        with gzip.open(tmp_path / name, "wb") as out:
            out.write(f"{name}\r\n1\r2\n".encode())
    names = lambda df: sorted(r.file.rsplit("/", 1)[1] for r in df.select("file").distinct().collect())
    want = ["a.log", "b.TXT", "c.md", "g.Log.GZ"]
    assert names(ls.read_lines(spark, str(tmp_path), allowed_only=True)) == want
    whole = ls.read_files(spark, str(tmp_path))
    assert names(whole) == want
    for row in whole.collect():
        assert row.text == row.file.rsplit("/", 1)[1] + "\n1\n2\n"
    assert len(names(ls.read_files(spark, str(tmp_path), allowed_only=False))) == 7


_ODD = {
    "shift_jis": [b"plain", "障害 ソ 表".encode("shift_jis"), b"a\x83", b"\x83\xff b", b"\xa0x\xfd", b"caf\xe9 z"],
    "gbk": [b"plain", "错误 连接".encode("gbk"), b"a\x81", b"\x81\xff b", b"\xff!"],
    "gb18030": [b"plain", "错误 €".encode("gb18030"), b"a\x81\x30", b"\x81\x30\x81", b"\xff!"],
    "euc-kr": [b"plain", "오류 연결".encode("euc-kr"), b"a\xef", b"na\xefve", b"\x80"],
    "utf-16-le": [b"a\0b\0", "ß 𝄞 障".encode("utf-16-le"), b"\x00\xd8a\0", b"\x00\xdca\0"],
    "utf-16-be": [b"\0a\0b", "ß 𝄞 障".encode("utf-16-be"), b"\xd8\x00\0a", b"\xdc\x00\0a", b"\0z\xd8\x00"],
}


@pytest.mark.parametrize("errors", ["replace", "ignore", "strict"])
@pytest.mark.parametrize("encoding", list(_ODD))
def test_charsets_of_several_bytes(spark, write, encoding, errors):
    end = "\n".encode(encoding)
    texts = [t for t in _ODD[encoding] if errors != "strict" or not any(c == "\ufffd" for c in t.decode(encoding, "replace"))]
    data = b"".join(t + end for t in texts)
    want = list(enumerate(data.decode(encoding, errors).split("\n")[:-1], 1))
    assert numbered(ls.read_lines(spark, write(data=data), encoding=encoding, decode_errors=errors)) == want
    whole = ls.read_files(spark, write(data=data), encoding=encoding, decode_errors=errors).first().text
    assert whole == data.decode(encoding, errors)
    if errors == "strict":
        with pytest.raises(Exception, match="(?i)decode"):
            ls.read_lines(spark, write(data=data + _ODD[encoding][2] + end), encoding=encoding, decode_errors=errors).collect()


def test_charsets_with_states_are_refused(spark, write):
    for encoding in ("utf-7", "hz", "iso2022_jp", "cp037", "base64", "utf-32"):
        with pytest.raises(ValueError):
            ls.read_lines(spark, write("x"), encoding=encoding)


@pytest.mark.parametrize("orders", [("le", "be", "le"), ("be", "be", "le"), ("be", "be", "be"), ("le", "le", "le")])
def test_byte_order_marks_hold_for_all_splits_of_a_file(spark, tmp_path, small_splits, orders):
    want, texts = {}, ["ERROR 障害 ß", "", "\u0a05 一 in\rside"] + [f"line {n} " + "é" * (n % 50) for n in range(300)]
    for i, order in enumerate(orders):
        name = f"{i} {order}.log"
        (tmp_path / name).write_bytes(("\ufeff" + "".join(t + "\r\n" for t in texts)).encode(f"utf-16-{order}"))
        want.update({(name, n): t for n, t in enumerate(texts, 1)})
    with gzip.open(tmp_path / "z.log.gz", "wb") as out:
        out.write("no mark\nß\n".encode("utf-16-le"))
    want.update({("z.log.gz", 1): "no mark", ("z.log.gz", 2): "ß"})
    found = ls.read_lines(spark, str(tmp_path), encoding="utf-16")
    keyed = lambda df: {(r.file.rsplit("/", 1)[1].replace("%20", " "), r.line_no): r.line for r in df.collect()}
    assert keyed(found) == want
    assert found.count() == len(want)
    kept = ls.read_lines(spark, str(tmp_path), encoding="utf-16", keep_split=True)
    assert keyed(kept) == want
    in_order = [(r.file, r.line_no) for r in kept.orderBy("split", "line_no").collect()]
    assert in_order == sorted(in_order)


def test_formats_of_marked_files(spark, tmp_path):
    for order in ("le", "be"):
        line = "<11>Dec 30 10:00:00 host app: fail\n"
        (tmp_path / f"{order}.log").write_bytes(("\ufeff" + line * 12).encode(f"utf-16-{order}"))
    _, found = ls.read_and_sniff(spark, str(tmp_path), encoding="utf-16")
    assert {r.detected for r in found.collect()} == {"syslog"}
    assert ls.triage(spark, str(tmp_path), encoding="utf-16", year="2025").count() >= 0
    with pytest.raises(ValueError):
        ls.read_lines(spark, str(tmp_path), encoding="utf-16", decode_errors="maybe")
