"""Operator 4: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic) with their
tokens.  Raking scales the cells' token weights to the target of each source,
each language and each topic in turn, never above the tokens a cell has, until
the marginals hold; a cell's sampling probability is its weight over its
tokens, and a document is sampled where a hash of its id and text falls below it.  All
steps are DataFrame operations; only the cell table, which does not grow with
the documents of a cell, is iterated, through tables in the shared folder.

Defined results.  A null source, language or topic is a value of its own.  A
null or empty text has no tokens; it is in a cell like any other and cells
without tokens have probability zero.  Rows repeated with id and text get one and
the same decision; different texts under one id, or without any, are drawn each.
With targets given, a value that they don't name gets weight zero.  Empty tables give an empty result; extra columns stay as they are.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, let, materialise, row_key, same_columns

#: Part of all tokens that the sample should hold.
BUDGET = 0.5
#: Targets by default: each marginal's share to this power, normalised.
FLATTEN = 0.7
TOPICS = 8
ROUNDS, TOLERANCE = 400, 5e-3
#: Errors are looked at every so many rounds, whatever the number of cells.
EVERY = 4
#: Raking stands still when no cell's probability moves by more in these rounds.
STANDSTILL = 1e-4
SEED = 17
#: Cells beyond this meet the documents in a shuffle join.
MAX_BROADCAST_CELLS = 50_000
#: Cells up to this many are raked in one task, more are shuffled.
MAX_ONE_TASK_CELLS = 50_000
LOG = logging.getLogger(__name__)
_DIMS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Token estimate in the JVM: a token per four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0).cast("bigint")


def hashed_topic(text: Column, topics: int = TOPICS) -> Column:
    """A vocabulary topic: words are dealt to ``topics`` classes by hash and the
    class of most words longer than four letters wins (ties: the smallest);
    ``none`` without such words.  A stand-in where no topic column is given."""
    if not 0 < topics <= 26:
        raise ValueError("between 1 and 26 topics")
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 4)
    letter = lambda w: F.char(F.pmod(F.hash(w), F.lit(topics)) + 97)
    of = lambda s, t: F.length(s) - F.length(F.replace(s, F.lit(chr(97 + t)), F.lit("")))
    sizes = lambda s: F.array(*[of(s, t) for t in range(topics)])
    best = lambda n: F.when(F.array_max(n) > 0, F.concat(F.lit("t"), (F.array_position(n, F.array_max(n)) - 1).cast("string"))).otherwise("none")
    # one letter a word, counted as a string
    return let(F.array_join(F.transform(words, letter), ""), lambda s: let(sizes(s), best))


def flattened_targets(cells: DataFrame, dim: str, power: float = FLATTEN) -> DataFrame:
    """``value, share``: shares of the tokens of each value, to a power, normalised."""
    m = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    total = m.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(power)))).first()[0]
    return m.select(F.col(dim).alias("value"), (F.pow(F.col("t").cast("double"), F.lit(power)) / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET,
         rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dims, ``tokens``) with ``weight``: tokens to sample of each.

    A round scales to each target in turn and caps weights at the cell's
    tokens.  Every ``EVERY`` rounds it ends when no marginal is off by more than
    ``tolerance`` of its target, when the weights stand still (the caps put the
    targets out of reach together), or after ``rounds`` rounds, which are
    rounded up to a multiple of ``EVERY``.  The error reached is logged."""
    # a table of bounded size is raked in one partition, without a shuffle, some
    # rounds at a time; a larger one with shuffled sums, a round at a time
    few = cells.count() <= MAX_ONE_TASK_CELLS
    whole = lambda d: d.coalesce(1) if few else d

    def with_sum(w: DataFrame, dim: str) -> DataFrame:
        if few:
            return w.withColumn("__have", F.sum("weight").over(Window.partitionBy(dim)))
        have = w.groupBy(F.col(dim).alias("__d")).agg(F.sum("weight").alias("__have"))
        return w.join(have, F.col(dim) == F.col("__d")).drop("__d")

    w = whole(cells).withColumn("weight", F.col("tokens") * F.lit(float(budget)))
    for dim, t in targets.items():
        goal = goal_tokens(whole(cells), dim, whole(t), budget).withColumnRenamed("__goal", f"__goal_{dim}")
        w = w.join(whole(goal), F.col(dim) == F.col("__v"), "left").drop("__v")
    w = whole(materialise(w.na.fill(0.0, [f"__goal_{d}" for d in targets]), "rake"))
    columns = w.columns
    for done in range(EVERY, rounds + EVERY, EVERY):
        w = w.withColumn("__from", F.col("weight"))
        for i in range(EVERY):
            for dim in targets:
                scaled = F.col("weight") * F.col(f"__goal_{dim}") / F.when(F.col("__have") > 0, F.col("__have"))
                w = with_sum(w, dim).withColumn("weight", F.least(F.col("tokens").cast("double"), F.coalesce(scaled, F.lit(0.0)))).drop("__have")
            if not few and i + 1 < EVERY:
                w = materialise(w, "rake")
        off = F.lit(0.0)
        for dim in targets:
            miss = F.when(F.col(f"__goal_{dim}") > 0, F.abs(F.col("__have") / F.col(f"__goal_{dim}") - 1)).otherwise(0.0)
            w = with_sum(w, dim).withColumn(f"__off_{dim}", miss).drop("__have")
            off = F.greatest(off, F.col(f"__off_{dim}"))
        moved = F.when(F.col("tokens") > 0, F.abs(F.col("weight") - F.col("__from")) / F.col("tokens")).otherwise(0.0)
        w = whole(materialise(w.select(*columns, off.alias("__off"), moved.alias("__moved")), "rake"))
        error, most = w.agg(F.max("__off"), F.max("__moved")).first()
        w = w.select(*columns)
        if not error or error <= tolerance or most <= STANDSTILL:
            break
    if rounds > 0:
        LOG.log(logging.WARNING if (error or 0.0) > tolerance else logging.INFO, "raking: %d rounds, targets missed by at most %.4f", done, error or 0.0)
    return w.select(*cells.columns, "weight")


def goal_tokens(cells: DataFrame, dim: str, target: DataFrame, budget: float) -> DataFrame:
    """``__v, __goal``: budget times all tokens by the target shares.  A value
    gets no more than the tokens it has; what it leaves goes to the others in
    proportion to their shares."""
    have = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("__have"))
    g = materialise(have.join(target, F.col(dim) == F.col("value")).select(F.col(dim).alias("__v"), "__have", "share"), "goals")
    wanted = float(budget) * (cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = wanted
    for _ in range(50):  # the set of values that give all they have only grows
        full = F.col("share") * F.lit(factor) >= F.col("__have")
        taken, rest = g.agg(F.sum(F.when(full, F.col("__have")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        new = (wanted - taken) / rest if rest else factor
        if not rest or new <= factor * (1 + 1e-9):
            break
        factor = new
    return g.select("__v", F.least(F.col("share") * F.lit(factor), F.col("__have")).alias("__goal"))


def cell_of(text_col: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, id_col: str = "doc_id") -> Column:
    """A struct of source, lang and topic (as labels that tell null from any
    text), tokens, and the key of the row's draw.  ``topic`` defaults to
    :func:`hashed_topic`."""
    topic = hashed_topic(F.col(text_col)) if topic is None else topic
    return F.struct(_label(F.col(source)).alias("source"), _label(F.col(lang)).alias("lang"),
                    _label(topic).alias("topic"), n_tokens(F.col(text_col)).alias("tokens"),
                    row_key(F.col(id_col), F.col(text_col)).alias("draw"))


def _label(c: Column) -> Column:
    return F.concat(F.when(c.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(c.cast("string"), F.lit("")))


def mix(docs: DataFrame, cell: str, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None,
        seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with, in place of the column ``cell`` (as made by
    :func:`cell_of`), a struct of topic, tokens, probability and sampled.
    ``docs`` is written once, so leave columns not needed out.  ``targets`` maps
    source, lang and topic to tables (value, share); by default shares are
    flattened."""
    d = materialise(docs, "mix-docs")
    cells = materialise(d.groupBy(*[F.col(f"{cell}.{c}").alias(c) for c in _DIMS]).agg(F.sum(f"{cell}.tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {c: materialise(flattened_targets(cells, c), "targets") for c in _DIMS}
    else:
        targets = {c: t.select(_label(F.col("value")).alias("value"), F.col("share").cast("double").alias("share")) for c, t in targets.items()}
    key, p = free_name(docs, "__mix_key"), free_name(docs, "__mix_p")
    w = rake(cells, targets, budget).select(
        F.struct(*_DIMS).alias(key), F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias(p))
    if cells.count() <= MAX_BROADCAST_CELLS:
        w = F.broadcast(w)
    j = d.join(w, F.struct(*[F.col(f"{cell}.{c}").alias(c) for c in _DIMS]) == F.col(key))
    u = F.pmod(F.xxhash64(F.col(f"{cell}.draw"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = F.struct(F.substring(F.col(f"{cell}.topic"), 2, 1 << 20).alias("topic"), F.col(f"{cell}.tokens").alias("tokens"),
                   F.col(p).alias("probability"), (u < F.col(p)).alias("sampled"))
    return same_columns(j.withColumn(cell, out), docs.columns)


def decisions(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, sampled`` of every row."""
    out = mix(docs.select("doc_id", "source", "lang", cell_of().alias("cell")), "cell")
    return out.select("doc_id", "source", "lang", "cell.topic", "cell.tokens", F.round("cell.probability", 9).alias("probability"), "cell.sampled")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their cell, probability and whether they are sampled."""
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents."""
    cell = free_name(docs, "__mix_cell")
    return same_columns(mix(docs.withColumn(cell, cell_of()), cell).filter(f"{cell}.sampled"), docs.columns)
