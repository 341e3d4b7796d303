"""Quoted line breaks: records put together over many splits equal a sequential parser's."""

import csv
import io
import random

import pytest

from tabprobe.sources import delimited, quoted


def sequential(text, sep):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def some_text(seed, n, sep, end):
    rng = random.Random(seed)
    signs = ["a", "b c", "é", '"', "\n", "\r\n", sep, "'", "\\", "5' pipe", "x" * 40]
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerow(["id", "na\nme", f"q{sep}x", "last"])
    for i in range(n):
        w.writerow([i, *["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(2)], "e"])
    w.writerow([n, "long " + "line\n" * 400, "after", "e"])  # spans many splits
    w.writerow([n + 1, "x", "y", "e"])
    return out.getvalue()


@pytest.mark.parametrize("split", [64, 257, 5000, 1 << 27])
@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n")])
def test_records_equal_a_sequential_parser(spark, tmp_path, split, sep, end):
    want = {}
    for k in range(2):  # every file has its own header and begins outside quotes
        text = some_text(k, 150, sep, end)
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want[k] = sequential(text, sep)
    before = {x: spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = quoted.read_quoted(spark, str(tmp_path), sep, "UTF-8", True)
        got = sorted(map(tuple, df.collect()))
        if split < 5000:
            assert df.rdd.getNumPartitions() >= 8
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)
    assert df.columns == want[0][0]
    assert got == sorted(tuple(r) for k in want for r in want[k][1:])


@pytest.mark.parametrize("line,inside,ends", [
    ('a,b', False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('a,"b"""', False, False), ('5" pipe,x', False, False),
    ('a,x"y,"z', False, True), ('b",c', True, False), ('b"",c', True, True), ('b",c,"d', True, True), ('', True, True), ('"', True, False), ('"', False, True), ('""', False, False)])
def test_states_of_a_line(line, inside, ends):
    assert quoted.ends_inside(line, inside, ",") == ends


def test_default_read_types_and_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note,v\n1,"line one\nline two",2.5\n2,?,NA\n3,"say ""hi""",4\n\n4,plain,5\n')
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "v": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, "line one\nline two", 2.5), (2, None, None), (3, 'say "hi"', 4.0), (4, "plain", 5.0)]
    (tmp_path / "h.csv").write_text('1,"a\nb"\n2,c\n')
    assert sorted(map(tuple, delimited.read_headerless(spark, str(tmp_path / "h.csv")).collect())) == [(1, "a\nb"), (2, "c")]


def test_latin1_and_unclosed_quotes(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('id,x\n1,"é\nü"\n2,ß\n'.encode("latin-1"))
    assert sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path / "l.csv")).collect())) == [(1, "é\nü"), (2, "ß")]
    (tmp_path / "u.csv").write_text('id,x\n1,a\n2,"never\nclosed\n')
    rows = delimited.read_delimited(spark, str(tmp_path / "u.csv")).collect()
    assert len(rows) == 2 and rows[0]["x"] == "a"


def test_header_names_with_separators(spark, tmp_path):
    (tmp_path / "n.csv").write_text('"a,b",c,c\n1,2,3\n')
    assert delimited.raw_header(spark, str(tmp_path / "n.csv")) == ["a,b", "c", "c"]


def test_round_trip_of_written_quotes(spark, tmp_path):
    rows = [(1, 'say "hi"'), (2, "two\nlines"), (3, 'back\\slash "'), (4, "a,b")]
    out = str(tmp_path / "w")
    delimited.write_table(spark.createDataFrame(rows, "id long, t string"), out)
    assert sorted(map(tuple, delimited.read_delimited(spark, out).collect())) == rows
