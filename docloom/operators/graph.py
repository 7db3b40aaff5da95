"""Citation graph of works: nodes, edges, degrees, layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_id(doi: Column, s2_id: Column, title: Column) -> Column:
    """DOI, else the other service's id, else the title's beginning."""
    return F.coalesce(F.nullif(doi, F.lit("")), F.concat(F.lit("s2:"), F.nullif(s2_id, F.lit(""))), F.concat(F.lit("t:"), F.lower(F.left(title, F.lit(60)))))


def citation_edges(works: DataFrame) -> DataFrame:
    """(source, target): each cited DOI once a work."""
    return works.select(node_id(F.col("doi"), F.col("s2_id"), F.col("title")).alias("source"), F.explode(F.array_distinct("referenced_dois")).alias("target")).where("source is not null and target is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends, counted before the shuffle."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def similar_edges(nodes: DataFrame, encode, least: float = 0.6) -> DataFrame:
    """(source, target, kind, weight) between nodes (node, title) of similar titles, source before target; none below three nodes.

    nodes is a graph's (at most a few dozen, a bound of the feature): they are compared in one task.
    Null and empty titles, and titles that are only a DOI, have no edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((n, t) for b in batches for n, t in zip(*(b.column(i).to_pylist() for i in range(2))))
        titled = [(n, t) for n, t in rows if t and not t.startswith("10.")]
        out: list[tuple[str, str]] = []
        if len(rows) >= 3 and titled:
            v = np.array(encode([t for _, t in titled]), float)
            at = np.argwhere(np.triu(v @ v.T >= least, 1))
            out = [(titled[i][0], titled[j][0]) for i, j in at]
        cols = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["source", "target"])

    found = nodes.select("node", "title").coalesce(1).mapInArrow(run, "source string, target string")
    return found.select("source", "target", F.lit("similar").alias("kind"), F.lit(0.5).alias("weight"))


def neighbourhood(works: DataFrame, seeds: DataFrame, most: int = 40, per_seed: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around seeds (node, at): each seed with up to half of per_seed works it cites and as many that cite it.

    Seeds always belong; others are admitted in order of arrival until there are `most` nodes. Edges
    have a kind and weight, between admitted nodes only.
    """
    half = max(2, per_seed // 2)
    edges = citation_edges(works)
    out = edges.join(seeds, edges.source == seeds.node).select("at", F.lit(0).alias("way"), "source", "target", F.col("target").alias("other"))
    into = edges.join(seeds, edges.target == seeds.node).select("at", F.lit(1).alias("way"), "source", "target", F.col("source").alias("other"))
    near = out.unionByName(into)
    r = F.row_number().over(Window.partitionBy("at", "way").orderBy("other"))
    near = near.withColumn("r", r).where(F.col("r") <= half)
    first = near.groupBy("other").agg(F.min(F.struct("at", "way", "r")).alias("o")).join(seeds.select(F.col("node").alias("other")), "other", "left_anti")
    count = seeds.agg(F.count("*").alias("s"))
    # At most seeds x per_seed rows are ranked here; both are bounds of the feature.
    admitted = first.withColumn("k", F.row_number().over(Window.orderBy("o", "other"))).crossJoin(F.broadcast(count)).where(F.col("k") <= most - F.col("s"))
    nodes = seeds.select("node", F.lit(True).alias("seed")).unionByName(admitted.select(F.col("other").alias("node"), F.lit(False).alias("seed")))
    kept = near.select("source", "target").distinct().join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    return nodes, kept.select("source", "target", F.lit("cites").alias("kind"), F.lit(1.0).alias("weight"))


def spring_layout(n: int, edges: list[tuple[int, int, float]], rounds: int = 300, seed: int = 7) -> np.ndarray:
    """Fruchterman-Reingold places in the box 60..940; equal graphs get equal places."""
    rng = np.random.default_rng(seed)
    if n == 1:
        return np.array([[500.0, 500.0]])
    p = rng.uniform(-0.5, 0.5, (n, 2))
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    k = 1 / np.sqrt(n)
    for step in range(rounds):
        d = p[:, None, :] - p[None, :, :]
        far = np.maximum(np.sqrt((d * d).sum(2)), 1e-3)
        force = k * k / far**2 - a * far / k
        np.fill_diagonal(force, 0)
        move = (d * force[:, :, None]).sum(1)
        size = np.maximum(np.sqrt((move * move).sum(1, keepdims=True)), 1e-9)
        p += move / size * np.minimum(size, 0.1 * (1 - step / rounds))
    low, high = p.min(0), p.max(0)
    return 60 + 880 * (p - low) / np.maximum(high - low, 1e-9)


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, x, y of a small graph (its node cap bounds it to one task's matrix)."""
    one = nodes.agg(F.array_sort(F.collect_set("node")).alias("nodes")).crossJoin(edges.agg(F.array_sort(F.collect_list(F.struct("source", "target", "weight"))).alias("edges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, es in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not names:
                    continue
                at = {x: i for i, x in enumerate(names)}
                p = spring_layout(len(names), [(at[e["source"]], at[e["target"]], e["weight"]) for e in es if e["source"] in at and e["target"] in at])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(p[:, 0].round(2)), pa.array(p[:, 1].round(2))], names=["node", "x", "y"])

    return one.mapInArrow(run, "node string, x double, y double")
