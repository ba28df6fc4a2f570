import csv
import io
import json
import time

import pytest

from lynceus.cli import RunError, main, run
from lynceus.sources import cache, feeds, lookup
from lynceus.sources.delimited import Cells, InputError, head_delimiter, read_delimited, unique_names


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def rows_of(spark, uri):
    df, layout = read_delimited(spark, uri)
    return [tuple(r)[1:] for r in df.orderBy("_row_id").collect()], layout


def test_shapes(spark, tmp_path):
    rows, layout = rows_of(spark, write(tmp_path / "a", "﻿id,Website URL,note\r\n1,http://a.test,x\r\n2,b.test,\"q,r\"\r\n"))
    assert rows == [("1", "http://a.test", "x"), ("2", "b.test", "q,r")] and layout.url_column == "Website URL"
    rows, layout = rows_of(spark, write(tmp_path / "b", "1;http://a.test\n2;http://b.test\n"))
    assert layout.header == ["column_1", "column_2"] and layout.url_index == 1 and len(rows) == 2
    rows, _ = rows_of(spark, write(tmp_path / "c", "id,url,note\n1,http://a.test,x,y,z\n2,http://b.test\n"))
    assert rows == [("1", "http://a.test", "x,y,z"), ("2", "http://b.test", "")]
    rows, layout = rows_of(spark, write(tmp_path / "d", "url,note\nhttp://a.test,caf\xe9 \x80\n".encode("latin-1")))
    assert layout.encoding == "cp1252" and rows == [("http://a.test", "café €")]
    rows, layout = rows_of(spark, write(tmp_path / "e", "http://a.test/x,y\nhttp://b.test\nhttp://c.test\n"))
    assert layout.delimiter == "\n" and rows[0] == ("http://a.test/x,y",)
    rows, layout = rows_of(spark, write(tmp_path / "f", 'url,note\nhttp://a.test,"two\nlines"\nhttp://b.test,z\n'))
    assert rows == [("http://a.test", "two\nlines"), ("http://b.test", "z")] and layout.multi_line
    rows, layout = rows_of(spark, write(tmp_path / "g", "url\tn\nhttp://ä.test\t1\n".encode("utf-16")))
    assert layout.encoding == "utf-16" and rows == [("http://ä.test", "1")]
    with pytest.raises(InputError, match="empty"):
        read_delimited(spark, write(tmp_path / "h", ""))
    with pytest.raises(InputError, match="not found"):
        read_delimited(spark, f"file://{tmp_path}/none")


def test_columns(spark):
    pick = lambda header, rows, wanted=None: Cells.of(spark, [header, *rows]).url_index(wanted, True)
    assert pick(["domain", "url"], []) == 1 and pick(["S.No", "Site Link"], []) == 1 and pick(["a", "b"], [["x", "http://q.test"]]) == 1
    assert unique_names(["a", "", "a", "a"]) == ["a", "column_2", "a_2", "a_3"] and head_delimiter(spark, "a,b\nc\n") == "\n"
    assert head_delimiter(spark, '"a,b";c\n"d";"e,f"') == ";"
    with pytest.raises(InputError):
        pick(["a"], [], "b")


def test_cells_over_lines_and_splits(spark, tmp_path):
    """Quoted cells with line breaks, doubled quotes and stray quotes, cut into many splits, against the csv module."""
    rows = [["id", "url", "note"]] + [[str(i), f"http://a{i}.test/", ["plain", 'two\nlines "quoted"', "\n\n", '"', 'a,b\n"",c', ""][i % 6]] for i in range(400)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    data = text.getvalue().replace("plain\n", 'a 5" disk\n', 20)
    want = [tuple(r) for r in list(csv.reader(io.StringIO(data, newline="")))[1:]]
    uri = write(tmp_path / "many", data)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got, layout = rows_of(spark, uri)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and len(layout.splits) > 10 and layout.multi_line


def test_folder(spark, tmp_path):
    for name, first in (("x", 0), ("y", 100), ("z", 200)):
        write(tmp_path / name, "id,url\n" + "".join(f"{first + k},http://a{k}.test\n" for k in range(50 + first)))
    got, layout = rows_of(spark, f"file://{tmp_path}")
    assert [int(r[0]) for r in got] == [*range(50), *range(100, 250), *range(200, 450)] and layout.header == ["id", "url"]


def test_csv_run(spark, tmp_path):
    source = write(tmp_path / "in.csv", "id,url,note\n3,http://b.test/login,z\n1,,y\n2,http://a.test,=x,more\n")
    out = tmp_path / "out.csv"
    s = run(spark, source, str(out))
    data = out.read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.count(b"\r\n") == 4
    rows = list(csv.DictReader(data.decode("utf-8-sig").splitlines()))
    assert [r["id"] for r in rows] == ["3", "1", "2"] and rows[1]["fraud_verdict"] == "ERROR" and rows[2]["note"] == "=x,more" and s["rows"] == 3 and sum(s["verdicts"].values()) == 3


def test_json_run(spark, tmp_path):
    out = tmp_path / "out.jsonl"
    run(spark, None, str(out), ["http://ä.test/", "", "x\udcff.test"])
    lines = out.read_text().splitlines()
    assert all(x.isascii() for x in lines)
    got = [json.loads(x) for x in lines]
    assert got[0]["url"] == "http://ä.test/" and got[1]["error"] == "empty URL" and got[1]["fraud_probability"] is None and "input" not in got[0] and got[0]["stages"]["offline_check"]["probability"] == got[0]["fraud_probability"]
    source = write(tmp_path / "in.csv", "url,note\nhttp://a.test,x\n")
    run(spark, source, str(out), fmt="json")
    assert json.loads(out.read_text())["input"] == {"url": "http://a.test", "note": "x"}


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be"])
def test_utf16_in_splits(spark, tmp_path, code):
    """Large files in many small splits: line ends at odd places are none, quotes run on, lone carriage returns end lines."""
    bom = "\ufeff".encode(code)
    odd = "\u0a41\u4e00\u0a00" if code == "utf-16-le" else "\u4e00\u0a41\u3000\u0a0a"  # a line feed's bytes stand between two characters
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999")  # cuts characters too
    try:
        for name, mark, end in (("plain", "ü", "\r\n"), ("odd", odd, "\n"), ("quoted", f'"{odd}\nmore, ""x"""', "\r\n"), ("lone", "ä", "\r"), ("both", odd, "\r")):
            want = [(str(i), f"http://h{i}.test/", mark * (i % 3 + 1) if '"' not in mark else mark) for i in range(300)]
            text = end.join(["id,url,note", *[",".join(r) for r in want]]) + end
            path = write(tmp_path / f"{name}-{code}", bom + text.encode(code))
            rows, layout = rows_of(spark, path)
            cells = [(i, u, mark if '"' not in mark else f'{odd}\nmore, "x"') if '"' in mark else (i, u, n) for i, u, n in want]
            assert layout.encoding == "utf-16" and rows == cells, name
            assert name in ("lone", "both") or len(layout.splits) > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_refusals(spark, tmp_path):
    source = str(tmp_path / "in.csv")
    write(tmp_path / "in.csv", "url\nhttp://a.test\n")
    for kw in ({"output": source}, {"output": f"{tmp_path}/no/x"}, {"fmt": "xml"}, {"base_rate": 1.5}, {"enrich": "some"}, {"urls": ["a"]}):
        with pytest.raises(RunError):
            run(spark, source, **kw)
    with pytest.raises(SystemExit):
        main([])


def test_cache(spark, tmp_path):
    lines = [{"k": "a", "t": 100.0, "v": {"x": 1}}, {"k": "a", "t": 50.0, "v": {"x": 2}}, {"k": "b", "t": 10.0, "v": {"x": 3}}]
    write(tmp_path / "log", "\n".join(map(json.dumps, lines)) + '\n{"k": "c", "t"')
    log = cache.read_log(spark, f"file://{tmp_path}/log", "x int")
    last = cache.last_written(log)
    assert {r.k: (r.t, r.v.x) for r in last.collect()} == {"a": (50.0, 2), "b": (10.0, 3)}  # the last line, not the newest time
    assert [r.k for r in cache.fresh(last, 86_400.0 + 20, 1).collect()] == ["a"]
    facts = spark.createDataFrame([("d", "ok", 4), ("e", "timeout", 5)], "k string, st string, x int")
    cache.append(facts, f"file://{tmp_path}/new", "k", "st", ("ok",), 7.0)
    assert [r.k for r in cache.snapshot(spark, f"file://{tmp_path}/new", "x int").collect()] == ["d"]


def test_feeds(spark, tmp_path):
    assert [r.url for r in feeds.line_feed(spark, write(tmp_path / "l", "# c\nhttp://a.test\n\nhttp://a.test\n")).collect()] == ["http://a.test"]
    assert {r.domain: r.rank for r in feeds.ranking(spark, write(tmp_path / "r", "1,A.test\n2,b.test\n3,a.test\n9,z.test\n"), 3).collect()} == {"a.test": 1, "b.test": 2}
    dump = feeds.dump_rows(spark, write(tmp_path / "d", "INSERT VALUES (1,'http://a.test',0),(2,'http://b.test',1);\n"), "\\((\\d+),'([^']*)',(\\d)\\)", {"url": 2, "label": 3})
    assert {(r.url, r.label) for r in dump.collect()} == {("http://a.test", "0"), ("http://b.test", "1")}


def test_kept_bootstrap(spark, tmp_path):
    """A copy is renewed when it is old, kept when it isn't, and serves, however old, when nothing better is to be had."""
    asked = []

    def fetch(url, accept, tld="test"):
        asked.append(url)
        return 200, json.dumps({"services": [[[tld], ["http://a.example/", "https://b.example/"]]]}), 0.0

    def broken(url, accept):
        raise OSError

    path = f"file://{tmp_path}/bootstrap.json"
    assert lookup.kept_bootstrap(spark, path, broken) is None
    assert [tuple(r) for r in lookup.kept_bootstrap(spark, path, fetch).collect()] == [("test", "https://b.example/")]
    assert lookup.kept_bootstrap(spark, path, fetch).count() == 1 and len(asked) == 1
    later = time.time() + 40 * 86_400
    assert lookup.kept_bootstrap(spark, path, broken, now=later).first().tld == "test"
    assert lookup.kept_bootstrap(spark, path, lambda u, a: (200, "torn {", 0.0), now=later).first().tld == "test"
    assert lookup.kept_bootstrap(spark, path, lambda u, a: fetch(u, a, "NEW"), now=later).first().tld == "new"
