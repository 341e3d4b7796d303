"""Delimited text whose quoted fields hold line breaks, read in parallel.

A line break ends a record unless it lies inside quotes, which depends on all text
before it. So the file is scanned in two passes over its ordinary splits:

1. Each split reports whether it ends inside quotes, under both hypotheses of how it
   begins (outside or inside). Composing these reports in file order tells how every
   split really begins; only splits that begin inside quotes, with the split that
   their record began in, are handed to the second pass.
2. Each split joins its lines to records. A record cut by a split's end leaves it in
   pieces (two a split at most) that meet by key.

A quote opens a field only at the field's start; inside quotes a doubled quote is one
quote. Every file begins outside quotes. Records come in file order, those cut by a
split's end last.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside quotes (or not) ends inside them."""
    i = 0
    while True:
        if inside:
            j = line.find('"', i)
            if j < 0:
                return True
            if line.startswith('"', j + 1):
                i = j + 2
                continue
            inside, i = False, j + 1
        elif line.startswith('"', i):
            inside, i = True, i + 1
            continue
        i = line.find(sep, i) + 1  # the next field's start
        if not i:
            return False


def text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, at, line): the lines of a path's files with the start of their split in the file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper().replace("-", "") == "UTF8" else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), value.alias("line"))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes; the scan stops at the first one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(F.contains("value", F.lit('"')) & (quotes % 2 == 1)).isEmpty()


def _splits(batches) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each split of a partition: runs of one (file, at)."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("line").to_pylist())
    for key, some in groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2] for r in some)


def _report_task(sep):
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()),
                        ("whole", pa.bool_()), ("head", pa.string())])

    def run(batches):
        for (file, at), lines in _splits(batches):
            out, inn = False, True
            whole = True  # no record begins here if the split begins inside quotes
            head, open_head = [], at == 0
            for line in lines:
                if open_head:
                    head.append(line)
                if '"' in line:
                    out, inn = ends_inside(line, out, sep), ends_inside(line, inn, sep)
                whole &= inn
                if open_head and not out:
                    if any(x.strip() for x in head):
                        open_head = False
                    else:
                        head = []
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (file, at, out, inn, whole, "\n".join(head) if at == 0 else None), schema)], schema=schema)
    return run


def _records_task(sep, begun, header):
    """(record) rows, and pieces (file, chain, at, piece) of records that a split's end cuts."""
    schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("chain", pa.int64()), ("at", pa.int64()), ("piece", pa.string())])

    def batch(records, piece=None):
        n = len(records) + (piece is not None)
        cols = [[*records, None]] + [[None] * len(records) + [x] for x in piece] if piece is not None else [records] + [[None] * n] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        for (file, at), lines in _splits(batches):
            chain = begun.value.get((file, at))  # where the record began that the split begins inside of
            inside, buf, records = chain is not None, [], []
            skip = header and at == 0
            for line in lines:
                buf.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside, sep)
                if inside:
                    continue
                text = "\n".join(buf)
                buf = []
                if chain is not None:
                    yield batch([], (file, chain, at, text))
                    chain = None
                    continue
                for record in [text] if '"' in text else text.split("\r"):
                    if not record.strip():
                        continue
                    if skip:
                        skip = False
                        continue
                    records.append(record.removesuffix("\r"))
                if len(records) >= 5000:
                    yield batch(records)
                    records = []
            if records:
                yield batch(records)
            if buf:  # cut by the split's end, or never closed
                yield batch([], (file, at if chain is None else chain, at, "\n".join(buf)))
    return run


def records(spark: SparkSession, path: str, sep: str, encoding: str, header: bool) -> tuple[list[str], DataFrame]:
    """(fields of the first file's first record, the records as a column ``record``), the
    first record of each file left out if it is a header."""
    lines = text_lines(spark, path, encoding)
    # one row a split; the driver gets as many rows as there are splits
    reports = lines.mapInArrow(_report_task(sep), "file string, at bigint, from_out boolean, from_in boolean, whole boolean, head string").collect()
    begun, file, inside, chain = {}, None, False, 0
    for r in sorted(reports, key=lambda r: (r["file"], r["at"])):
        if r["file"] != file:
            file, inside = r["file"], False
        if inside:
            begun[r["file"], r["at"]] = chain
        ends = r["from_in"] if inside else r["from_out"]
        if ends and not (inside and r["whole"]):  # its last record began in this split
            chain = r["at"]
        inside = ends
    heads = [r["head"] for r in sorted(reports, key=lambda r: r["file"]) if r["head"]]
    names = next(csv.reader([heads[0].removesuffix("\r")], delimiter=sep), []) if heads else []
    shared = spark.sparkContext.broadcast(begun)  # splits that begin inside quotes
    got = lines.mapInArrow(_records_task(sep, shared, header), "record string, file string, chain bigint, at bigint, piece string")
    cut = (got.where("piece IS NOT NULL").groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("z"))
              .select(F.regexp_replace(F.array_join("z.piece", "\n"), "\r$", "").alias("record")))
    return names, got.where("record IS NOT NULL").select("record").unionAll(cut)


def safe_names(names: Sequence[str]) -> list[str]:
    """Column names as Spark's reader makes them: repeated ones get their position, empty ones a name."""
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_quoted(spark: SparkSession, path: str, sep: str, encoding: str, header: bool) -> DataFrame:
    """All-string table of a path's records."""
    first, rows = records(spark, path, sep, encoding, header)
    names = safe_names(first) if header else [f"_c{i}" for i in range(len(first))]
    if not names:
        return spark.createDataFrame([], "_c0 string")
    ddl = ", ".join(f"f{i} string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": "", "multiLine": "true", "lineSep": "\u0001",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    parsed = rows.select(F.from_csv("record", F.lit(ddl), options).alias("r"))
    return parsed.select(*[F.col(f"r.f{i}").alias(n) for i, n in enumerate(names)])
