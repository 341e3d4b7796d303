"""A paged index in Spark: page rows and requests meet by key, the page is opened
once and requests are streamed through it.

Both kinds of rows are dealt by key and sorted, page rows first, so a task
holds one page at a time whatever the number of requests, and no page is copied."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serve(pages: DataFrame, requests: DataFrame, key: list[str], open_page: Callable, answer: Callable, ddl: str) -> DataFrame:
    """Rows that ``answer(page, requests)`` yields as record batches of the schema ``ddl``.

    ``open_page(rows)`` makes a page of all page rows (a pyarrow table) of a key. Requests
    whose key has no page rows get no answer. Columns missing on one side are null there."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pages.withColumn("_kind", F.lit(0)).unionByName(requests.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(n, *key).sortWithinPartitions(*key, "_kind")

    def run(batches):
        here, rows, page = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), batch.column("_kind").to_pylist()))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = batch.slice(at, end - at)
                if keys[at][:-1] != here:
                    here, rows, page = keys[at][:-1], [], None
                if keys[at][-1] == 0:
                    rows.append(part)
                elif rows or page is not None:
                    if page is None:
                        page, rows = open_page(pa.Table.from_batches(rows)), []
                    yield from answer(page, part)
                at = end
    return dealt.mapInArrow(run, ddl)


def bytes_matrix(col, dtype, width: int):
    """A binary column of equally long arrays as a matrix."""
    import numpy as np
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)
