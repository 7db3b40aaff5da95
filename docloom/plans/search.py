"""Search queries over the chunks, vectors and documents tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.columns import preview
from docloom.functions.norm import tokens
from docloom.operators import index, search, similarity
from docloom.plans.base import query
from docloom.session import table

#: The queries asked: words that the corpus has in a part of its chunks.
ASKED, RELAXED, MODEL = "grip strength dystonia", "dystonia zzyzxq", "static-64"
TOKEN_SQL = r"[\p{L}\p{N}_\-]+"
CHUNKS_SQL = "SELECT doc_id, idx, any_value(page) AS page, coalesce(any_value(norm), '') AS norm FROM chunks WHERE doc_id IS NOT NULL AND idx IS NOT NULL GROUP BY doc_id, idx"


def bm25_sql(rows: str, text: str, parts: list[str], dl: str, keep: str, where: str) -> str:
    """SQL of keep and score over rows; where speaks of tf0, tf1 and so on."""
    tf = ", ".join(f"CAST((length({text}) - length(replace({text}, '{p}', ''))) / {len(p)} AS INTEGER) AS tf{i}" for i, p in enumerate(parts))
    counts = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS n{i}" for i in range(len(parts)))
    idf = [f"ln((N - n{i} + 0.5) / (n{i} + 0.5))" for i in range(len(parts))]
    score = " + ".join(f"(CASE WHEN {x} <= 0 THEN 1e-6 ELSE {x} END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, x in enumerate(idf))
    return (
        f"WITH counted AS (SELECT {keep}, CAST({dl} AS DOUBLE) AS dl, {tf} FROM ({rows})), stats AS (SELECT count(*) AS N, avg(dl) AS avgdl, {counts} FROM counted) "
        f"SELECT {keep}, round({score}, 6) AS score FROM counted, stats WHERE {where}"
    )


def keyword_sql(terms: list[str], how: str, limit: int) -> str:
    rows = f"SELECT *, ' ' || array_to_string(regexp_extract_all(norm, '{TOKEN_SQL}'), '  ') || ' ' AS s, len(regexp_extract_all(norm, '{TOKEN_SQL}')) AS n FROM ({CHUNKS_SQL})"
    where = how.join(f"tf{i} > 0" for i in range(len(terms)))
    return bm25_sql(rows, "s", [search.phrase(t) for t in terms], "n", "doc_id, idx", where) + f" ORDER BY score DESC, doc_id, idx LIMIT {limit}"


def jargon_sql(terms: list[str], limit: int) -> str:
    long = [t for t in terms if len(t) >= 5]
    where = " AND ".join(f"tf{i} > 0" for i in range(len(long)))
    return bm25_sql(CHUNKS_SQL, "norm", long, "greatest(length(norm) - 2, 0)", "doc_id, idx", where) + f" ORDER BY score DESC, doc_id, idx LIMIT {limit}"


_OK = "vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0"
SEMANTIC_SQL = (
    f"WITH ok AS (SELECT vec_id, doc_id, idx, CAST(vec AS DOUBLE[]) AS v FROM vectors WHERE model = '{MODEL}' AND dim = 64 AND {_OK}), q AS (SELECT v AS qv FROM ok ORDER BY vec_id LIMIT 1) "
    "SELECT * FROM (SELECT doc_id, idx, max(round(list_cosine_similarity(v, qv), 6)) AS score FROM ok, q GROUP BY doc_id, idx ORDER BY score DESC, doc_id, idx LIMIT 40) WHERE score > 0.15"
)


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The model's first usable vector stands in for an encoded query."""
    rows = search.usable_vectors(table(spark, folder, "vectors").where(f"model = '{MODEL}' and dim = 64"))
    return list(rows.select("vec_id", "vec").orderBy("vec_id").limit(1).collect()[0].vec)


@query(f"SELECT doc_id, idx, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, idx, unnest(regexp_extract_all(norm, '{TOKEN_SQL}')) AS term FROM ({CHUNKS_SQL})) GROUP BY ALL")
def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    return index.postings(table(spark, folder, "chunks"))


_TERMS_SQL = (
    r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(strip_accents(lower(coalesce(title, '') || chr(10) || coalesce(text, ''))), '[\p{L}\p{N}_]+(?:[''\-][\p{L}\p{N}_]+)*'), "
    r"lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\p{N}+') AND length(regexp_replace(w, '[^a-z]', '', 'g')) >= 3)) AS term FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL"
)


@query(_TERMS_SQL)
def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    return index.doc_terms(table(spark, folder, "documents"))


@query(f"SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM ({_TERMS_SQL}) GROUP BY term")
def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return index.vocabulary(index.doc_terms(table(spark, folder, "documents")))


@query(f"SELECT w AS term FROM (SELECT unnest(['dystonia', 'tremour', 'zzyzxq', 'neuropathie', 'grip']) AS w) WHERE w NOT IN (SELECT term FROM ({_TERMS_SQL}))")
def vocab_missing_terms(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame([(t,) for t in ("dystonia", "tremour", "zzyzxq", "neuropathie", "grip")], "term string")
    return index.missing_terms(asked, vocab(spark, folder))


@query()
def phonetic_expand(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.createDataFrame([(t,) for t in ("distonia", "tremur", "dystonia", "neuropathie")], "term string")
    return index.expand(asked, vocab(spark, folder))


@query(
    f"SELECT (SELECT count(DISTINCT doc_id) FROM chunks) AS docs, (SELECT count(*) FROM ({CHUNKS_SQL})) AS chunks, "
    f"(SELECT count(*) FROM vectors WHERE {_OK}) AS embedded, (SELECT min(model) FROM vectors) AS model, (SELECT count(DISTINCT term) FROM ({_TERMS_SQL})) AS vocabulary"
)
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    chunks = index.chunk_rows(table(spark, folder, "chunks")).agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks"))
    vectors = table(spark, folder, "vectors")
    some = search.usable_vectors(vectors).agg(F.count("*").alias("embedded")).crossJoin(vectors.agg(F.min("model").alias("model")))
    return chunks.crossJoin(some).crossJoin(vocab(spark, folder).agg(F.count("*").alias("vocabulary")))  # one row each


@query(keyword_sql(tokens(ASKED), " AND ", 60))
def search_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return search.keyword(table(spark, folder, "chunks"), [[t] for t in tokens(ASKED)], 60)


@query(keyword_sql(tokens(RELAXED), " OR ", 60))
def search_and_or_relax(spark: SparkSession, folder: str) -> DataFrame:
    """No chunk has both words, so any of them will do."""
    return search.keyword(table(spark, folder, "chunks"), [[t] for t in tokens(RELAXED)], 60)


@query(jargon_sql(tokens(ASKED), 40))
def search_jargon(spark: SparkSession, folder: str) -> DataFrame:
    return search.jargon(table(spark, folder, "chunks"), tokens(ASKED), 40)


@query(SEMANTIC_SQL)
def search_semantic(spark: SparkSession, folder: str) -> DataFrame:
    return search.semantic(table(spark, folder, "vectors"), _query_vector(spark, folder), MODEL, 40)


def _ranked(sql: str, route: str, place: int) -> str:
    return f"SELECT doc_id, idx, '{route}' AS route, {place} AS place, row_number() OVER (ORDER BY score DESC, doc_id, idx) AS rank FROM ({sql})"


HYBRID_SQL = (
    f"WITH r AS ({_ranked(keyword_sql(tokens(ASKED), ' AND ', 60), 'keyword', 0)} UNION ALL {_ranked(jargon_sql(tokens(ASKED), 40), 'jargon', 1)} UNION ALL {_ranked(SEMANTIC_SQL, 'semantic', 2)}), "
    "f AS (SELECT doc_id, idx, sum(1.0::DOUBLE / (60 + rank)) AS s, array_to_string(list_sort(list(DISTINCT route)), ' ') AS routes, min(place * 1000 + rank) AS o FROM r GROUP BY doc_id, idx) "
    "SELECT doc_id, idx, round(s, 5) AS score, routes FROM f ORDER BY round(s, 9) DESC, o, doc_id, idx LIMIT 20"
)


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "chunks"), table(spark, folder, "vectors"), ASKED, query_vector=_query_vector(spark, folder), model=MODEL)


@query(HYBRID_SQL)
def search_hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).withColumn("routes", F.array_join("routes", " "))


@query(
    "WITH hits AS (" + bm25_sql(
        f"SELECT *, ' ' || array_to_string(regexp_extract_all(norm, '{TOKEN_SQL}'), '  ') || ' ' AS s, len(regexp_extract_all(norm, '{TOKEN_SQL}')) AS n FROM ({CHUNKS_SQL})",
        "s", [search.phrase("dystonia")], "n", "doc_id, idx", "tf0 > 0") + ") SELECT * FROM hits WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, doc_id, idx LIMIT 60"
)
def search_doc_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Restricted to English documents; the statistics stay those of all chunks."""
    return search.keyword(table(spark, folder, "chunks"), [["dystonia"]], 60, table(spark, folder, "documents").where("lang = 'en'"))


@query()
def search_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return search.materialise(_hybrid(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "documents"), tokens(ASKED))


_DOC_TEXT = "' ' || array_to_string(regexp_extract_all(lower(coalesce(@, '')), '" + TOKEN_SQL + "'), '  ') || ' '"


def _document_sql() -> str:
    t, b = _DOC_TEXT.replace("@", "title"), _DOC_TEXT.replace("@", "left(text, 2000000)")
    count = lambda p: f"((length(t) - length(replace(t, '{p}', ''))) // {len(p)} + (length(b) - length(replace(b, '{p}', ''))) // {len(p)})"
    parts = [" tremor ", " cor"]
    idf = lambda i: f"ln((N - n{i} + 0.5) / (n{i} + 0.5))"
    score = " + ".join(f"(CASE WHEN {idf(i)} <= 0 THEN 1e-6 ELSE {idf(i)} END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(2))
    return (
        f"WITH d AS (SELECT doc_id, {t} AS t, {b} AS b FROM documents), c AS (SELECT doc_id, {count(parts[0])} AS tf0, {count(parts[1])} AS tf1, "
        "CAST(((length(t) - length(replace(t, ' ', ''))) + (length(b) - length(replace(b, ' ', '')))) // 2 AS DOUBLE) AS dl FROM d), "
        "s AS (SELECT count(*) AS N, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0) AS n0, count(*) FILTER (WHERE tf1 > 0) AS n1 FROM c) "
        f"SELECT doc_id, round({score}, 6) AS score FROM c, s WHERE tf0 > 0 AND tf1 > 0 ORDER BY score DESC, doc_id LIMIT 20"
    )


@query(_document_sql())
def search_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Title or body with both words, the last one as a prefix."""
    return search.search_documents(table(spark, folder, "documents"), "tremor cor")


_PASSAGES_SQL = f"SELECT h.*, row_number() OVER (ORDER BY score DESC, doc_id, idx) AS rank FROM ({keyword_sql(tokens(ASKED), ' AND ', 12)}) h"
_CONTEXT_SQL = r"coalesce('[' || doc_id || coalesce(' p.' || page, '') || '] ' || coalesce(d.title, '') || chr(10) || trim(regexp_replace(coalesce(c.text, ''), '[ \t\r\n\f]+', ' ', 'g')), '')"


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.keyword(table(spark, folder, "chunks"), [[t] for t in tokens(ASKED)], 12)
    from pyspark.sql.window import Window

    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "idx")))  # twelve rows
    body = index.chunk_rows(table(spark, folder, "chunks")).select("doc_id", "idx", "page", "text").join(F.broadcast(ranked), ["doc_id", "idx"])
    return body.join(table(spark, folder, "documents").select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left")


@query(
    f"SELECT p.rank, p.doc_id, p.idx, c.page, coalesce(c.text, '') AS text FROM ({_PASSAGES_SQL}) p JOIN (SELECT doc_id, idx, any_value(page) AS page, any_value(text) AS text FROM chunks GROUP BY ALL) c USING (doc_id, idx)".replace("GROUP BY ALL", "GROUP BY doc_id, idx")
)
def search_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve best hits with their whole text, for answering."""
    return _passages(spark, folder).select("rank", "doc_id", "idx", "page", F.coalesce("text", F.lit("")).alias("text"))


@query(
    "SELECT coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), 'No passages found.') AS context FROM (SELECT p.rank, "
    r"'[' || p.doc_id || coalesce(' p.' || c.page, '') || '] ' || coalesce(d.title, '') || chr(10) || left(trim(regexp_replace(coalesce(c.text, ''), '[ \t\r\n\f]+', ' ', 'g')), 600) AS part "
    f"FROM ({_PASSAGES_SQL}) p JOIN (SELECT doc_id, idx, any_value(page) AS page, any_value(text) AS text FROM chunks GROUP BY doc_id, idx) c USING (doc_id, idx) LEFT JOIN documents d ON d.doc_id = p.doc_id)"
)
def ask_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of a question to a model, passage after passage; a fixed sentence without any."""
    page = F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit(""))
    part = F.concat(F.lit("["), F.col("doc_id").cast("string"), page, F.lit("] "), F.coalesce("doc_title", F.lit("")), F.lit("\n"), preview(F.coalesce("text", F.lit(""))))
    listed = _passages(spark, folder).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return listed.select(F.when(F.size("p") == 0, F.lit("No passages found.")).otherwise(joined).alias("context"))


@query(
    "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS squared, round(CAST(embedding[1] AS DOUBLE) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS first "
    "FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
)
def l2_normalise(spark: SparkSession, folder: str) -> DataFrame:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.round(search.dot(wide, wide), 4).alias("squared"), F.round(F.element_at(search.unit(F.col("embedding")), 1), 6).alias("first"))


@query(
    "SELECT a.vec_id AS query_id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) >= 0.3"
)
def similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector as a query against all."""
    rows = table(spark, folder, "embeddings")
    return similarity.similar_to(rows.where("vec_id % 50 = 0"), rows, 0.3)
