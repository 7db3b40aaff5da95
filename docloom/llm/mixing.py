"""Mixing sources to target weights by a low-discrepancy schedule (problem 8).

Slot i of the mixture gets the point frac(i / golden ratio); the cumulative weights map the point to a
source, and the rank of the slot among its source's slots names a block of equally many tokens. The
blocks of a source are cut from its documents in shuffled order, laid out once for each allowed
repeat. Slots and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.bpe import token_counts
from docloom.session import cut

#: The points live on a ring of 2^31 places; the step is the odd number next to 2^31 / golden ratio.
RING, STEP = 1 << 31, 1_327_217_885
#: Slots ranked in one window, and tokens (at most about) ordered in one window.
#: Blocks of the source of least weight: its share is met to about one part in so many.
FINE = 64
SLOT_RUN, TOKEN_RUN = 1 << 16, 1 << 24


@dataclass(frozen=True)
class Mixture:
    blocks: DataFrame
    shares: DataFrame


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int | None = None, total_tokens: int | None = None, seed: int = 7, tokenizer: str | None = None) -> Mixture:
    """The largest mixture in which every present source has its weight, or one of total_tokens.

    Blocks are as large a power of two (16 to 2,048 tokens) as leaves the source of least weight
    FINE blocks of the mixture, so that their number doesn't follow the corpus.

    docs: doc_id, source, text. targets: source, weight, max_repeat; a table of settings, read to the
    driver. blocks: slot, source, doc_id, repeat (from 0), token_from, token_to (of the document's
    ids, end exclusive). shares: one row for each target with what it reached. Documents of other
    sources, with null source, with no tokens, and targets with null or non-positive weight or
    max_repeat below 1 take no part; a target without documents reaches 0 and the others keep their
    proportions (target_share is over the present ones). Rows that repeat a doc_id are documents of
    their own. Repeated targets: the first by weight counts. With total_tokens beyond what the caps
    allow, the mixture ends where the first source runs out, as weights would be missed after it.
    Nothing to mix gives empty blocks.
    """
    spark = docs.sparkSession
    rows = targets.groupBy("source").agg(F.max(F.struct("weight", "max_repeat")).alias("t")).select("source", "t.*").orderBy("source").collect()
    wanted = [r for r in rows if r.source is not None and (r.weight or 0) > 0 and (r.max_repeat or 0) >= 1]
    names = spark.createDataFrame([(r.source, r.max_repeat) for r in wanted], "source string, max_repeat int")
    sized = cut(token_counts(docs.join(F.broadcast(names.select("source")), "source", "left_semi"), ["doc_id", "source"], path=tokenizer).where("n_tokens > 0"), "sized")
    have = {r.source: (r.n, r.d) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")).collect()}
    present = [r for r in wanted if r.source in have]
    weight = sum(r.weight for r in present) or 1.0
    if block_tokens is None:
        tokens = min((have[r.source][0] * r.max_repeat * weight / r.weight for r in present), default=0)
        least = min((r.weight / weight for r in present), default=0) * min(tokens, total_tokens or tokens)
        block_tokens = 1 << min(11, max(4, int(least / FINE).bit_length() - 1))
    full = {r.source: have[r.source][0] * r.max_repeat // block_tokens for r in present}
    most = min((full[r.source] * weight / r.weight for r in present), default=0)
    n = int(most) + len(present) + 8  # some more, as the schedule may run a little behind; cut below
    if total_tokens is not None:
        n = min(n, total_tokens // block_tokens)
    if not present or most < 1:
        n = 0
    edges, at = [], 0.0
    for r in present:
        at += r.weight / weight
        edges.append(round(at * RING))
    slots = _slots(spark, n, [r.source for r in present], edges)
    if n:
        caps = F.create_map(*[F.lit(x) for s, k in full.items() for x in (s, k)])
        end = slots.where(F.col("block") >= caps[F.col("source")]).agg(F.min("slot")).first()[0]
        if end is not None:
            slots = slots.where(F.col("slot") < end)
    spans = _spans(sized, names, {s: x[0] for s, x in have.items()}, block_tokens, seed)
    # Only blocks that the schedule names are cut: their number follows the mixture, not the corpus.
    spans = spans(slots.groupBy("source").agg((F.max("block") + 1).alias("named")))
    blocks = slots.join(spans, ["source", "block"]).select("slot", "source", "doc_id", "repeat", "token_from", "token_to")
    shares = _shares(spark, blocks, rows, {r.source: r.weight / weight for r in present}, have)
    return Mixture(blocks, shares)


def _slots(spark, n: int, sources: list[str], edges: list[int]) -> DataFrame:
    """(slot, source, block): the schedule, ranked for each source in two levels (runs, then slots)."""
    point = (F.col("slot") % RING) * STEP % RING
    which = F.size(F.filter(F.array(*[F.lit(e) for e in edges or [RING]]), lambda e: e <= point))
    named = F.element_at(F.array(*[F.lit(s) for s in sources or [""]]), F.least(which, F.lit(max(0, len(sources) - 1))) + 1)
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") / SLOT_RUN).cast("long").alias("run")).withColumn("source", named)
    before = slots.groupBy("source", "run").count().withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("run")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    return slots.withColumn("r", rank).join(before.drop("count"), ["source", "run"]).select("slot", "source", (F.col("before") + F.col("r")).alias("block"))


def _spans(sized: DataFrame, names: DataFrame, have: dict[str, int], size: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """A function from (source, named blocks) to (source, block, doc_id, repeat, token_from, token_to): shuffled documents cut at every size tokens.

    The running total is taken in two levels, as one source may hold a third of all rows: documents
    fall into runs by a hash, so many that a run holds about TOKEN_RUN tokens, totals of runs are
    summed, and only within a run documents are ordered.
    """
    runs = max(1, max(have.values(), default=0) // TOKEN_RUN)
    copies = sized.join(F.broadcast(names), "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("max_repeat") - 1)))
    mixed = copies.withColumn("h", F.xxhash64(F.lit(seed), "repeat", "doc_id")).withColumn("run", F.pmod("h", F.lit(runs)))
    totals = mixed.groupBy("source", "repeat", "run").agg(F.sum("n_tokens").alias("n"))
    totals = totals.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("repeat", "run")) - F.col("n")).drop("n")
    inner = Window.partitionBy("source", "repeat", "run").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = mixed.withColumn("upto", F.sum("n_tokens").over(inner)).join(totals, ["source", "repeat", "run"])
    laid = laid.withColumn("b", F.col("base") + F.col("upto")).withColumn("a", F.col("b") - F.col("n_tokens"))

    def cut_for(named: DataFrame) -> DataFrame:
        last = F.least(F.col("b") - 1, F.col("named") * size - 1)
        met = laid.join(F.broadcast(named), "source").where(F.col("a") < F.col("named") * size)
        met = met.withColumn("block", F.explode(F.sequence((F.col("a") / size).cast("long"), (last / size).cast("long"))))
        return _span_columns(met, size)

    return cut_for


def _span_columns(laid: DataFrame, size: int) -> DataFrame:
    return laid.select("source", "block", "doc_id", "repeat", (F.greatest(F.col("a"), F.col("block") * size) - F.col("a")).alias("token_from"), (F.least(F.col("b"), (F.col("block") + 1) * size) - F.col("a")).alias("token_to"))


def _shares(spark, blocks: DataFrame, rows: list, share: dict[str, float], have: dict) -> DataFrame:
    """One row for each target; the totals are those of the blocks that came out."""
    plain = spark.createDataFrame(
        [(r.source, r.weight, share.get(r.source, 0.0), r.max_repeat, have.get(r.source, (0, 0))[0], have.get(r.source, (0, 0))[1]) for r in rows],
        "source string, weight double, target_share double, max_repeat int, source_tokens bigint, source_docs bigint",
    )
    got = blocks.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.max("repeat").alias("r"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    out = plain.join(got, "source", "left").crossJoin(F.broadcast(total))
    return out.select(
        "source", "weight", "target_share", "max_repeat", "source_docs", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce(F.col("r") + 1, F.lit(0)).alias("times_used"),
    )
