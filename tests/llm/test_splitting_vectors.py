"""Problem 2 against a plain search for the best cut; problem 4 against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import splitting, vectors


def plain_cuts(text, limit, overlap):
    places, strengths = splitting.boundaries(text)
    at = dict(zip(places, strengths))
    out, start, n = [], 0, len(text)
    while n - start > limit:
        end = start + limit
        least = max(overlap + 1, limit // 2)
        for low, high in ((start + least, end), (start + overlap + 1, start + least - 1)):
            c = [(at[p], p) for p in range(low, high + 1) if p in at]
            if c:
                end = max(c)[1]
                break
        out.append((start, end))
        start = end - overlap
    return out + [(start, n)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .,;\n\f。"), min_size=1, max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_cuts_are_the_strongest(text, limit, overlap):
    text = text.strip()
    got = splitting.cuts(text, limit, overlap)
    assert got == plain_cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got) and all(c[0] == a[1] - overlap for a, c in zip(got, got[1:]))


def test_range_maximum_ties_go_right():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 4, 500).tolist()
    s = splitting.StrongestCut(v, 64)
    for _ in range(2000):
        i = int(rng.integers(0, 499))
        j = int(rng.integers(i + 1, 501))
        assert s.best(i, j) == max(range(i, j), key=lambda k: (v[k], k))


def test_long_text_uses_several_tables(monkeypatch):
    text = "some words, and more. " * 3000
    whole = splitting.cuts(text.strip(), 2200, 150)
    monkeypatch.setattr(splitting, "TABLE", 700)
    assert splitting.cuts(text.strip(), 2200, 150) == whole


def test_split_table(spark):
    long = "  " + "A sentence here. " * 300 + "\n"
    rows = [(1, 0, 1, long), (1, 0, 1, long), (2, 0, None, "short "), (3, 0, 1, None), (4, 0, 1, " \n　"), (None, None, None, "x" * 5000), (5, 1, 2, "y" * 2200)]
    df = spark.createDataFrame(rows, "doc_id bigint, idx int, page int, text string").withColumn("piece", F.lit("clash")).withColumn("start", F.lit(1))
    got = splitting.split(df).collect()
    assert {(r.doc_id, r.pieces > 1) for r in got} == {(1, True), (2, False), (None, True), (5, False)}
    one = sorted((r.piece, r.start, r.stop, r.text) for r in set(got) if r.doc_id == 1)
    assert all(long[a:b] == t and len(t) <= 2200 for _, a, b, t in one) and one[0][1] == 2 and one[-1][2] == len(long.rstrip())
    assert all(t.endswith(".") for _, _, _, t in one) and all(b[3].startswith(a[3][-150:]) for a, b in zip(one, one[1:]))
    assert next(r.text for r in got if r.doc_id == 2) == "short"
    assert splitting.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, 100, 60)


def brute(rows, k=5):
    out = {}
    for m in {r[1] for r in rows}:
        mine = sorted((r[0], np.array(r[3], float)) for r in rows if r[1] == m)
        u = np.stack([v / np.linalg.norm(v) for _, v in mine])
        s = np.round(u @ u.T, 10)
        for i, (a, _) in enumerate(mine):
            order = sorted((j for j in range(len(mine)) if j != i), key=lambda j: (-s[i, j], mine[j][0]))[:k]
            out[a] = {mine[j][0] for j in order}
    return out


def clustered(n, dim, seed, model):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 15), dim))
    which = (rng.pareto(1.0, n) * 3).astype(int) % len(centres)
    return [centres[c] + 0.15 * rng.normal(size=dim) for c in which], model


def test_neighbours_against_brute_force(spark):
    rows = []
    for n, dim, seed, model in ((1500, 16, 1, "a"), (400, 8, 2, "b")):
        for v, m in ((v, model) for v in clustered(n, dim, seed, model)[0]):
            rows.append((len(rows) * 3, m, dim, [float(np.float32(x)) for x in v]))
    df = spark.createDataFrame(rows, "vec_id bigint, model string, dim int, vec array<float>")
    got = {}
    for r in vectors.neighbours(df, leaf=64).collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    want = brute(rows)
    right = sum(len(want[a] & got.get(a, set())) for a in want)
    assert right / sum(map(len, want.values())) >= 0.95 and all(len(v) <= 5 for v in got.values())


def test_copies_ties_and_dirt(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(i, "a", 3, base) for i in range(10)] + [(20, "a", 3, [2.0, 4.0, 6.0]), (21, "a", 3, [3.0, 2.0, 1.0])]
    bad = [(30, "a", 3, None), (31, "a", 3, [1.0]), (32, "a", 3, [0.0] * 3), (33, "a", 3, [float("nan")] * 3), (34, "a", 3, [float("inf"), 1.0, 1.0]), (35, "a", 3, [None, 1.0, 1.0]), (36, None, 3, base), (None, "a", 3, base), (37, "a", None, base), (38, "lone", 3, base)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id bigint, model string, dim int, vec array<float>").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(0))
    got = {}
    for r in vectors.neighbours(df).collect():
        got.setdefault(r.vec_id, set()).add(r.other_id)
    assert got[0] == {1, 2, 3, 4, 5} and got[9] == {0, 1, 2, 3, 4} and got[20] == {0, 1, 2, 3, 4} and got[21] == {0, 1, 2, 3, 4}
    assert not set(got) & {30, 31, 32, 33, 34, 35, 36, 37, 38} and not {o for v in got.values() for o in v} & {30, 31, 32, 33, 34, 35}
    assert vectors.neighbours(df.limit(0)).count() == 0


def test_beam_is_the_shared_queue():
    """The leaves that a priority queue over all trees would pop first."""
    import heapq

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = vectors.grow(x, 600, 3, 16, 4)
    row, leaf, own = vectors.search(forest, x[:50].astype(np.float32), 7)
    for q in range(50):
        heap, popped = [(0.0, t, 0, 0) for t in range(3)], []
        heapq.heapify(heap)
        while len(popped) < 7:
            p, t, level, node = heapq.heappop(heap)
            if level == forest.depth:
                popped.append((p, t * (1 << forest.depth) + node))
                continue
            m = float(forest.trees[t].normal[level][node] @ x[q].astype(np.float32) - forest.trees[t].bound[level][node])
            near = int(m > 0)
            heapq.heappush(heap, (p, t, level + 1, 2 * node + near))
            heapq.heappush(heap, (max(p, abs(m)), t, level + 1, 2 * node + 1 - near))
        worst = popped[-1][0]
        assert {c for p, c in popped if p < worst - 1e-6} <= set(leaf[row == q].tolist())
        assert own[row == q].sum() >= 3
