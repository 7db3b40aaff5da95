"""The search index as plain derivations: chunks, postings, vocabulary, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import INDEX_TOKEN, fold, matches
from docloom.functions.norm import phonetic_udf
from docloom.session import spread


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks by their key, a chunk delivered twice once; null norm is empty."""
    kept = chunks.where("doc_id is not null and idx is not null").dropDuplicates(["doc_id", "idx"])
    return kept.select("doc_id", "idx", "page", "text", F.coalesce("norm", F.lit("")).alias("norm"))


def index_tokens(norm: Column) -> Column:
    return matches(norm, INDEX_TOKEN)


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, term, tf): counted before the one shuffle, in which no text is moved.

    Each row also says once which terms it has, so that a chunk delivered twice is counted and divided
    by its deliveries.
    """
    w = index_tokens(F.coalesce("norm", F.lit("")))
    rows = chunks.where("doc_id is not null and idx is not null").select("doc_id", "idx", w.alias("w"))
    both = F.concat(F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("row"))), F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("row"))))
    words = rows.select("doc_id", "idx", F.inline(both))
    return words.groupBy("doc_id", "idx", "term").agg((F.sum("n") / F.sum("row")).cast("int").alias("tf"))


def vocabulary_words(text: Column) -> Column:
    """Folded words of three characters or more that are not all digits and can be spoken (three Latin letters or more)."""
    words = matches(fold(F.coalesce(text, F.lit(""))), r"[\p{L}\p{N}_]+(?:['\-][\p{L}\p{N}_]+)*")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{N}+$") & w.rlike("[a-z](?:.*[a-z]){2}"))


def doc_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, n) over title and text; the vocabulary is the sum of these, never kept apart."""
    both = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    rows = spread(docs.where("doc_id is not null").select("doc_id", "title", "text"))
    return rows.select("doc_id", F.explode(vocabulary_words(both)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def vocabulary(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def phonetic_vocabulary(vocab: DataFrame) -> DataFrame:
    """(term, n, key): words with a phonetic key; Python sees each distinct word once."""
    return vocab.withColumn("key", phonetic_udf("term")).where("key <> ''")


def missing_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Query terms (column term) that the vocabulary hasn't."""
    return terms.join(vocab.select("term"), "term", "left_anti")


def expand(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(term, alternative, n): for unknown terms of four letters or more the most frequent words that sound alike.

    Of the six most frequent those within three letters of the term's length, at most four; ties by
    word.
    """
    from pyspark.sql.window import Window

    unknown = missing_terms(terms.where("length(term) >= 4 and not term rlike '^[0-9]+$'"), vocab).withColumn("key", phonetic_udf("term")).where("key <> ''")
    known = phonetic_vocabulary(vocab).select(F.col("term").alias("alternative"), "n", "key")
    order = Window.partitionBy("term").orderBy(F.desc("n"), "alternative")
    six = known.join(unknown, "key").withColumn("r", F.row_number().over(order)).where("r <= 6 and abs(length(alternative) - length(term)) <= 3")
    return six.withColumn("r", F.row_number().over(order)).where("r <= 4").select("term", "alternative", "n")
