"""Hybrid search: BM25 keyword route, substring route, vector route, reciprocal rank fusion.

A query is a handful of terms, so nothing is exploded: term frequencies are counted in place, the
collection statistics come from one aggregate of one row, and each route ends in a top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.columns import INDEX_TOKEN
from docloom.functions.norm import snippet_udf, tokens
from docloom.operators.index import index_tokens
from docloom.session import cut, spread

K1, B = 1.2, 0.75
KEY = ["doc_id", "idx"]


def phrase(term: str) -> str:
    """A term as it stands in the spaced token string; an apostrophe parts tokens, so such a term is a phrase."""
    import regex

    return " " + "  ".join(regex.findall(INDEX_TOKEN, term)) + " "


def spaced(norm: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(index_tokens(norm), "  "), F.lit(" "))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def phrase_count(norm: Column, term: str) -> Column:
    """Occurrences of a term as whole tokens; only rows with its letters are taken apart."""
    parts = phrase(term).split()
    there = _all([F.contains(norm, F.lit(p)) for p in parts]) if parts else F.lit(False)
    return F.when(there, occurrences(spaced(norm), phrase(term))).otherwise(0)


def bm25(rows: DataFrame, tf: list[Column], dl: Column, keep: list[str]) -> DataFrame:
    """keep, tf0.. and score of all rows, with statistics over all rows; phrases that most rows have score almost nothing."""
    n = len(tf)
    # Statistics, scores and the test for strict hits all need the counts: a few numbers a row, written
    # once, instead of three scans of the texts.
    counted = rows.select(*keep, dl.cast("double").alias("dl"), *(c.alias(f"tf{i}") for i, c in enumerate(tf)))
    counted = cut(counted.dropDuplicates(keep), "counted")  # a row delivered twice counts once; only numbers are moved for that
    stats = counted.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(n)))
    both = counted.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        f, k = F.col(f"tf{i}"), F.col(f"n{i}")
        idf = F.log((F.col("N") - k + 0.5) / (k + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return both.select(*keep, *(f"tf{i}" for i in range(n)), F.round(reduce(lambda a, b: a + b, (part(i) for i in range(n))), 6).alias("score"))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def keyed(chunks: DataFrame) -> DataFrame:
    """Key and norm of chunks that have a key; null norm is empty."""
    return chunks.where("doc_id is not null and idx is not null").select(*KEY, F.coalesce("norm", F.lit("")).alias("norm"))


def keyword(chunks: DataFrame, groups: list[list[str]], limit: int, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, score: every group of alternatives must occur; if no row has them all, any will do.

    The statistics are those of all chunks, whatever doc_ids restricts the result to.
    """
    flat = [t for g in groups for t in g]
    if not flat:
        return chunks.sparkSession.createDataFrame([], "doc_id bigint, idx int, score double")
    rows = spread(keyed(chunks))
    scored = bm25(rows, [phrase_count(F.col("norm"), t) for t in flat], F.regexp_count("norm", F.lit(INDEX_TOKEN)), KEY)
    at, hits = 0, []
    for g in groups:
        hits.append(_any([F.col(f"tf{i}") > 0 for i in range(at, at + len(g))]))
        at += len(g)
    scored = scored.where(_any(hits)).withColumn("strict", _all(hits))
    if doc_ids is not None:
        scored = scored.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    # Rows with all groups come first; relaxed rows count only where there is no strict one.
    strict = scored.agg(F.max("strict").alias("some"))
    kept = scored.crossJoin(F.broadcast(strict)).where(F.col("strict") | ~F.col("some"))
    return kept.orderBy(F.desc("score"), *KEY).limit(limit).select(*KEY, "score")


def jargon(chunks: DataFrame, terms: list[str], limit: int, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, score: all terms of five characters or more as substrings, by BM25 over character triples."""
    long = [t for t in terms if len(t) >= 5]
    if not long:
        return chunks.sparkSession.createDataFrame([], "doc_id bigint, idx int, score double")
    rows = spread(keyed(chunks))
    scored = bm25(rows, [occurrences(F.col("norm"), t) for t in long], F.greatest(F.length("norm") - 2, F.lit(0)), KEY)
    scored = scored.where(_all([F.col(f"tf{i}") > 0 for i in range(len(long))]))
    if doc_ids is not None:
        scored = scored.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return scored.orderBy(F.desc("score"), *KEY).limit(limit).select(*KEY, "score")


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors as long as dim says, of finite numbers, not all zero."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size("vec") == F.col("dim")) & fine & F.exists("vec", lambda x: x != 0))


def unit(vec: Column) -> Column:
    """The vector at length 1 in doubles; a zero vector stays zero."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def semantic(vectors: DataFrame, query: list[float], model: str, limit: int, floor: float = 0.15, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, score: chunks by cosine with the query vector, best first, above the floor.

    A batch of vectors is one matrix product; only what passes the floor leaves the scan (the floor is
    below every kept score, so taking it before the limit changes nothing). Broken vectors don't answer.
    """
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            whole = np.nonzero((v.value_lengths().fill_null(0).to_numpy() == len(q)) & ~v.is_null().to_numpy(zero_copy_only=False))[0]
            part = b.take(pa.array(whole))
            x = part.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, len(q))
            n = np.sqrt((x * x).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.round((x @ q) / n, 6)
            hit = np.nonzero(np.isfinite(n) & (n > 0) & (s > floor))[0]
            take = pa.array(hit)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(s[hit])], names=["doc_id", "idx", "score"])

    rows = vectors.where((F.col("model") == model) & (F.col("dim") == len(query)))
    if doc_ids is not None:
        rows = rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = rows.select(*KEY, "vec").mapInArrow(run, "doc_id bigint, idx int, score double").groupBy(*KEY).agg(F.max("score").alias("score"))
    return scored.orderBy(F.desc("score"), *KEY).limit(limit)


def fuse(routes: dict[str, DataFrame], limit: int, k: int = 60) -> DataFrame:
    """doc_id, idx, score, routes: reciprocal rank fusion; ties by the order of routes, then rank, then key."""
    parts = []
    for i, (name, df) in enumerate(routes.items()):
        # Each route is a top-k already, so its one window is small.
        r = F.row_number().over(Window.orderBy(F.desc("score"), *KEY))
        parts.append(df.select(*KEY, F.lit(name).alias("route"), F.lit(i).alias("place"), r.alias("rank")))
    all_routes = reduce(DataFrame.unionByName, parts)
    fused = all_routes.groupBy(*KEY).agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.array_sort(F.collect_set("route")).alias("routes"), F.min(F.struct("place", "rank")).alias("first"))
    fused = fused.withColumn("score", F.round("s", 5))
    return fused.orderBy(F.desc(F.round("s", 9)), "first.place", "first.rank", *KEY).limit(limit).select(*KEY, "score", "routes")


def search(chunks: DataFrame, vectors: DataFrame | None, text: str, *, limit: int = 20, mode: str = "auto", expansions: dict[str, list[str]] | None = None, query_vector: list[float] | None = None, model: str = "", doc_ids: DataFrame | None = None) -> DataFrame:
    """Fused hits of a query; an unknown mode has no route and finds nothing. An empty doc_ids (None) restricts nothing."""
    terms = tokens(text)
    routes: dict[str, DataFrame] = {}
    if terms and mode in ("auto", "keyword", "all"):
        routes["keyword"] = keyword(chunks, [[t, *(expansions or {}).get(t, [])] for t in terms], limit * 3, doc_ids)
        if any(len(t) >= 5 for t in terms):
            routes["jargon"] = jargon(chunks, terms, limit * 2, doc_ids)
    if query_vector and vectors is not None and mode in ("auto", "semantic", "all"):
        routes["semantic"] = semantic(vectors, query_vector, model, limit * 2, doc_ids=doc_ids)
    if not routes:
        return chunks.sparkSession.createDataFrame([], "doc_id bigint, idx int, score double, routes array<string>")
    return fuse(routes, limit)


def materialise(hits: DataFrame, chunks: DataFrame, docs: DataFrame, want: list[str]) -> DataFrame:
    """Hits with page, title and snippet; a hit without its chunk drops out. Snippets are cut for the hits only."""
    # hits is a top-k: the chunks and titles are read through, and only hits are made unique.
    body = chunks.select(*KEY, "page", "text").join(F.broadcast(hits), KEY).dropDuplicates(KEY)
    titles = docs.select("doc_id", "title").join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    found = body.join(titles, "doc_id", "left")
    return found.select(*KEY, "page", "score", "routes", F.coalesce("title", F.lit("")).alias("title"), snippet_udf(want)("text").alias("snippet"))


def search_documents(docs: DataFrame, text: str, limit: int = 20, title_weight: float = 1.0, cap: int = 2_000_000) -> DataFrame:
    """doc_id, score: documents whose title or body has every term, the last one as a prefix.

    Title and body are indexed apart and a term may stand in either; both weigh the same unless
    title_weight says otherwise.
    """
    words = tokens(text)[:12]
    if not words:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, score double")

    def tidy(c: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(index_tokens(F.lower(F.coalesce(c, F.lit("")))), "  "), F.lit(" "))

    rows = spread(docs.where("doc_id is not null").select("doc_id", "title", "text")).select("doc_id", tidy(F.col("title")).alias("t"), tidy(F.left("text", F.lit(cap))).alias("b"))
    last = len(words) - 1
    tf: list[Column] = []
    for i, w in enumerate(words):
        part = phrase(w)[:-1] if i == last else phrase(w)
        tf.append(title_weight * occurrences(F.col("t"), part) + occurrences(F.col("b"), part))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))  # noqa: E731 - two for each token
    scored = bm25(rows, tf, F.floor((blanks(F.col("t")) + blanks(F.col("b"))) / 2), ["doc_id"])
    return scored.where(_all([F.col(f"tf{i}") > 0 for i in range(len(words))])).orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", "score")
