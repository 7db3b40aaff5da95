"""A stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Query vectors sent to the tasks at a time; more are taken block by block.
BLOCK = 4096


def similar_to(queries: DataFrame, rows: DataFrame, least: float, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, other_id, cosine): all rows at cosine `least` or more of a query, without the query itself.

    queries and rows have key and vec, of one dimension. Null, empty, zero and non-finite vectors match
    nothing. Queries are read in blocks of BLOCK by key, each broadcast on its own.
    """
    spark = rows.sparkSession
    shape = "query_id bigint, other_id bigint, cosine double"
    picked = queries.select(key, vec).where(f"{key} is not null and size({vec}) > 0").orderBy(key)
    out, last = [], None
    while True:
        part = (picked if last is None else picked.where(picked[key] > last)).limit(BLOCK).collect()
        if not part:
            break
        last = part[-1][0]
        dim = len(part[0][1])
        q = [(r[0], np.array(r[1], float)) for r in part if len(r[1]) == dim and None not in r[1]]
        q = [(i, x / np.linalg.norm(x)) for i, x in q if np.isfinite(x).all() and x.any()]
        if q:
            held = spark.sparkContext.broadcast((np.array([i for i, _ in q]), np.stack([x for _, x in q])))

            def run(batches: Iterator[pa.RecordBatch], held=held, dim=dim) -> Iterator[pa.RecordBatch]:
                ids, m = held.value
                for b in batches:
                    got = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and v is not None and len(v) == dim and None not in v]
                    if not got:
                        continue
                    x = np.array([v for _, v in got], float)
                    n = np.linalg.norm(x, axis=1)
                    fine = np.isfinite(n) & (n > 0)
                    s = np.round(m @ (x / np.where(fine, n, 1.0)[:, None]).T, 6)
                    own = np.array([i for i, _ in got])
                    a, c = np.nonzero((s >= least) & fine[None, :] & (ids[:, None] != own[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[c]), pa.array(s[a, c])], names=["query_id", "other_id", "cosine"])

            out.append(rows.select(key, vec).mapInArrow(run, shape))
        if len(part) < BLOCK:
            break
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], shape)
