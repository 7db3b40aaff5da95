"""Nearest vectors of every vector by a forest of random-projection trees (problem 4).

Trees are grown on the driver from a bounded sample; every vector is then indexed. Each vector looks
for leaves in all trees at once, through one priority queue: the near side of a split keeps the
priority of its node, the far side gets the negative distance to the split if that is lower. As
priorities never rise on the way down and each node has a leaf of its own priority, taking the best
`probes` nodes level by level gives the very leaves that such a queue would pop first, and does so for
a batch of vectors at a time. Candidates that share a leaf are reranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import cut

#: Most vectors of a model that a forest is grown from, and the fewest of them in a leaf.
SAMPLE, LEAST_IN_LEAF = 32_768, 8


@dataclass
class Tree:
    """A full binary tree: node i of level l splits by normal[l][i]·x > bound[l][i]."""

    normal: list[np.ndarray]
    bound: list[np.ndarray]


@dataclass
class Forest:
    trees: list[Tree]
    depth: int
    extra: int  # bits below the sampled trees, for collections much larger than the sample
    extra_normal: np.ndarray  # tree, bit, dim
    extra_bound: np.ndarray  # tree, leaf, bit


def grow(sample: np.ndarray, n: int, trees: int, leaf: int, seed: int) -> Forest:
    """A forest for n vectors, from unit rows of sample. Splits are medians, so dense regions get more leaves."""
    rng = np.random.default_rng(seed)
    need = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    depth = min(need, max(0, int(np.log2(max(1, len(sample)) / LEAST_IN_LEAF))))
    extra, dim = need - depth, sample.shape[1]
    out, e_normal, e_bound = [], np.zeros((trees, extra, dim), np.float32), np.zeros((trees, 1 << depth, extra), np.float32)
    for t in range(trees):
        groups, normal, bound = [np.arange(len(sample))], [], []
        for _ in range(depth):
            ns, bs, kids = [], [], []
            for g in groups:
                a, b = sample[rng.choice(g, 2, replace=len(g) < 2)] if len(g) else (np.zeros(dim), np.zeros(dim))
                d = a - b
                if np.linalg.norm(d) < 1e-6:
                    d = rng.standard_normal(dim)
                d = d / np.linalg.norm(d)
                p = sample[g] @ d
                m = float(np.median(p)) if len(g) else 0.0
                right = p > m
                ns.append(d)
                bs.append(m)
                kids += [g[~right], g[right]]
            normal.append(np.asarray(ns, np.float32))
            bound.append(np.asarray(bs, np.float32))
            groups = kids
        out.append(Tree(normal, bound))
        if extra:
            e_normal[t] = rng.standard_normal((extra, dim))
            for i, g in enumerate(groups):
                if len(g):
                    e_bound[t, i] = np.median(sample[g] @ e_normal[t].T, axis=0)
    return Forest(out, depth, extra, e_normal, e_bound)


def search(forest: Forest, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best probes leaves of each row of x over all trees: (row, code of tree and leaf, is it the row's own leaf)."""
    n, trees = len(x), len(forest.trees)
    tree = np.tile(np.arange(trees), (n, 1))
    node = np.zeros((n, trees), np.int64)
    priority = np.zeros((n, trees), np.float32)
    for level in range(forest.depth):
        normal = np.stack([t.normal[level] for t in forest.trees])
        bound = np.stack([t.bound[level] for t in forest.trees])
        margin = np.einsum("nkd,nd->nk", normal[tree, node], x, optimize=False) - bound[tree, node]
        near = (margin > 0).astype(np.int64)
        tree = np.concatenate([tree, tree], 1)
        node = np.concatenate([2 * node + near, 2 * node + 1 - near], 1)
        priority = np.concatenate([priority, np.minimum(priority, -np.abs(margin))], 1)
        if priority.shape[1] > probes:
            keep = np.argsort(-priority, axis=1, kind="stable")[:, :probes]
            tree, node, priority = (np.take_along_axis(a, keep, 1) for a in (tree, node, priority))
    row = np.repeat(np.arange(n), tree.shape[1])
    t, v, own = tree.ravel(), node.ravel(), priority.ravel() == 0
    code = v
    if forest.extra:
        bits = np.einsum("med,md->me", forest.extra_normal[t], x[row]) > forest.extra_bound[t, v]
        code = v << forest.extra | (bits << np.arange(forest.extra)).sum(1)
    return row, t * (1 << (forest.depth + forest.extra)) + code, own


def rerank(query: np.ndarray, query_id: np.ndarray, data: np.ndarray, data_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data id, cosine to 10 decimals) of each query's k best others among data, by smaller id where cosines tie.

    Rows are unit vectors. The cosines of the few best are summed anew, always in the same order, so
    that a pair has one value whatever leaf it is met in.
    """
    order = np.argsort(data_id, kind="stable")
    data, data_id = data[order], data_id[order]
    take = min(k + 3, len(data))
    rows, ids, cosines = [], [], []
    for at in range(0, len(query), 2048):
        q, qi = query[at : at + 2048], query_id[at : at + 2048]
        s = np.round(q @ data.T, 9)
        best = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(data) else np.tile(np.arange(len(data)), (len(q), 1))
        lowest = np.take_along_axis(s, best, 1).min(1)
        for i in np.nonzero((s >= lowest[:, None]).sum(1) > take)[0]:  # ties at the edge: the smallest ids
            best[i] = np.argsort(-s[i], kind="stable")[:take]
        c = np.round((q[:, None, :] * data[best]).sum(2), 10)
        i = data_id[best]
        c[i == qi[:, None]] = -9
        o = np.lexsort((i, -c), axis=1)[:, :k]
        c, i = np.take_along_axis(c, o, 1), np.take_along_axis(i, o, 1)
        r, j = np.nonzero(c > -9)
        rows.append(r + at)
        ids.append(i[r, j])
        cosines.append(c[r, j])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(cosines)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """Rows whose vec is not null, as long as dim, of finite numbers, and not of zeros only."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "model", "dim", "vec").where(
        F.col("vec_id").isNotNull() & F.col("model").isNotNull() & (F.size("vec") == F.col("dim")) & (F.col("dim") > 0) & fine & F.exists("vec", lambda x: x != 0)
    )


def neighbours(vectors: DataFrame, k: int = 5, trees: int = 6, probes: int = 12, leaf: int = 256, seed: int = 11) -> DataFrame:
    """(vec_id, other_id, cosine): each valid vector's k most similar of its model and dim, ties by smaller id.

    Approximate: what shares none of the probed leaves is missed (recall is measured in the tests and
    the README). Copies of a vector are searched once, by their smallest vec_id, and share the result,
    so a vector that fills a third of the table costs no more than another; of the members of a class
    only the k + 1 smallest ids can answer. Broken vectors (see valid) neither ask nor answer. A vector
    without another one of its model gives no row. Rows that repeat a vec_id: ids are taken as unique,
    exact repeats of a row count once. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).withColumn("h1", F.xxhash64(F.lit(1), "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec"))
    classes = cut(rows.groupBy("model", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("vec").alias("vec"), F.count("*").alias("n")), "classes")
    nearest = cut(_nearest(classes, k, trees, probes, leaf, seed), "nearest")  # used twice below
    many = classes.where("n > 1").select("model", "dim", "h1", "h2", "rep")
    members = rows.select("vec_id", "model", "dim", "h1", "h2").join(many, ["model", "dim", "h1", "h2"]).select("vec_id", "rep").distinct()
    first = Window.partitionBy("rep").orderBy("vec_id")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("vec_id").alias("heads"))
    others = nearest.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.c").alias("c"), (-F.col("x.m")).alias("other"))
    others = others.join(heads.withColumnRenamed("rep", "other"), "other", "left").select("rep", "c", F.explode(F.coalesce("heads", F.array("other"))).alias("id"))
    own = heads.select("rep", F.lit(1.0).alias("c"), F.explode("heads").alias("id"))
    lists = others.unionByName(own).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", (-F.col("id")).alias("m"))), asc=False).alias("near"))
    # Inner joins only, of which either side can be split where one class has very many members.
    alone = lists.join(heads.select("rep"), "rep", "left_anti").withColumn("vec_id", F.col("rep"))
    asking = lists.join(members, "rep").select("rep", "near", "vec_id").unionByName(alone.select("rep", "near", "vec_id"))
    kept = F.slice(F.filter("near", lambda x: x.m != -F.col("vec_id")), 1, k)
    return asking.select("vec_id", F.explode(kept).alias("x")).select("vec_id", (-F.col("x.m")).alias("other_id"), F.col("x.c").alias("cosine"))


def _nearest(classes: DataFrame, k: int, trees: int, probes: int, leaf: int, seed: int) -> DataFrame:
    """(rep, near: ARRAY<c, m = -other rep>) of each class, best first, at most k."""
    spark = classes.sparkSession
    sizes = classes.groupBy("model", "dim").count().collect()  # one row for each model
    forests = {}
    for s in sizes:
        one = classes.where((F.col("model") == s.model) & (F.col("dim") == s.dim)).select("rep", "vec")
        if s["count"] > SAMPLE:
            one = one.orderBy(F.xxhash64("rep")).limit(SAMPLE)
        got = one.toArrow()
        x = _unit(got.column("vec").combine_chunks(), s.dim)[np.argsort(got.column("rep").to_numpy())]
        forests[(s.model, s.dim)] = grow(x, s["count"], trees, leaf, seed)
    number = {m: i for i, m in enumerate(sorted(forests))}
    held = spark.sparkContext.broadcast(forests)  # bounded by SAMPLE / LEAST_IN_LEAF nodes a tree

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models, dims = b.column(0).to_pylist(), b.column(1).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(models, dims)):
                groups.setdefault(key, []).append(i)
            for key, places in groups.items():
                for at in range(0, len(places), 2000):
                    part = b.take(pa.array(places[at : at + 2000]))
                    row, code, own = search(held.value[key], _unit(part.column(3), key[1]).astype(np.float32), probes)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), number[key], np.int32)), pa.array(code), pa.array(own), part.column(2).take(take), part.column(3).take(take)], names=["m", "leaf", "own", "rep", "vec"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            m, leaf_of = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = [*(np.nonzero((np.diff(m) != 0) | (np.diff(leaf_of) != 0))[0] + 1), b.num_rows]
            at = 0
            for e in ends:
                part = b.slice(at, e - at)
                at = e
                if held_back and (held_back[0].column(0)[0], held_back[0].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                    yield from _leaf(held_back, k)
                    held_back = []
                held_back.append(part)
        if held_back:
            yield from _leaf(held_back, k)

    probed = classes.select("model", "dim", "rep", "vec").mapInArrow(probe, "m int, leaf bigint, own boolean, rep bigint, vec array<float>")
    met = probed.repartition("m", "leaf").sortWithinPartitions("m", "leaf").mapInArrow(meet, "rep bigint, near array<struct<c:double,m:bigint>>")
    gathered = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most probes lists of k
    return gathered.select("rep", F.slice(F.sort_array("near", asc=False), 1, k).alias("near"))


def _leaf(parts: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(parts).combine_chunks()
    rep, own = t.column("rep").to_numpy(), t.column("own").to_numpy()
    vec = t.column("vec").combine_chunks()
    x = _unit(vec, len(vec[0]))
    if not own.any():
        return
    row, other, c = rerank(x, rep, x[own], rep[own], k)
    counts = np.bincount(row, minlength=len(rep))
    there = counts > 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts[there])]).astype(np.int32))
    near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c), pa.array(-other)], ["c", "m"]))
    yield pa.RecordBatch.from_arrays([pa.array(rep[there]), near], names=["rep", "near"])
