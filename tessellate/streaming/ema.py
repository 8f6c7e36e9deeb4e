"""STR-01: exponential moving average carried across steps per key.

``ema = beta * prev + (1 - beta) * value``; ``prev`` is the key's previous
EMA, or the seed when the key has no state yet (``seed='first'`` seeds with
the key's first value, a number seeds with that number).  A key absent from a
step keeps its state, so the fold runs over the steps where the key appears.

Batch form: one ``groupBy(key)`` collects the key's *history* (one entry per
step, not per row; callers aggregate rows to steps first) and JVM-side
``aggregate`` higher-order functions fold it, any number of statistics at once.
History length is the number of training steps, bounded by the training
schedule rather than by data volume.  The history is folded in blocks of about
the square root of its length, so that growing the output costs
length ** 1.5 copies at most.

Long histories: :func:`ema_scan` collects no key.  A step maps the state x to
``clamp(a x + b)`` with a >= 0, and such maps are closed under composition, so
blocks of steps are composed in parallel, the states before the blocks come from
the composed maps (again by blocks while a key has many), and every block is
then folded from its own start.

Streaming form: :mod:`tessellate.streaming.ema_stream`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once

#: Steps that :func:`ema_scan` composes or folds together.
BLOCK = 512


@dataclass(frozen=True)
class Ema:
    """One statistic to fold: input column, decay, output column, seed, and
    bounds *inside* the recursion (the stored previous value is the bounded one)."""

    value: str
    beta: float
    out: str = "ema"
    seed: str | float = "first"
    clamp: tuple[float, float] | None = None

    def step(self, prev: Column, value: Column) -> Column:
        seeded = F.coalesce(prev, value if self.seed == "first" else F.lit(float(self.seed)))
        e = ema_update(seeded, value, self.beta)
        # a null value leaves no state, with or without bounds
        return e if self.clamp is None else F.when(e.isNotNull(), F.greatest(F.lit(self.clamp[0]), F.least(F.lit(self.clamp[1]), e)))


def ema_update(prev: Column, value: Column, beta: float) -> Column:
    return F.lit(beta) * prev + F.lit(1.0 - beta) * value


def ema_folds(df: DataFrame, keys: Sequence[str], order: str, emas: Sequence[Ema],
              init_state: DataFrame | None = None) -> DataFrame:
    """``keys, order`` and the EMA of each statistic after each step of each key.

    ``init_state`` optionally supplies the values carried over from earlier
    batches: ``keys`` and a column named like each ``out``.
    """
    keys, n = list(keys), range(len(emas))
    entry = F.struct(F.col(order).cast("bigint").alias("o"), *[F.col(m.value).cast("double").alias(f"v{i}") for i, m in enumerate(emas)])
    hist = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_h"))
    if init_state is not None:
        prev = init_state.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                                 F.struct(*[F.col(m.out).cast("double").alias(f"p{i}") for i, m in enumerate(emas)]).alias("_p"))
        hist = hist.join(prev, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left")
        start = F.struct(*[F.col(f"_p.p{i}").alias(f"p{i}") for i in n])
    else:
        start = F.struct(*[F.lit(None).cast("double").alias(f"p{i}") for i in n])

    one = "struct<o:bigint," + ",".join(f"e{i}:double" for i in n) + ">"

    def step(acc, x):
        e = [m.step(acc["prev"][f"p{i}"], x[f"v{i}"]) for i, m in enumerate(emas)]
        row = F.struct(x["o"].alias("o"), *[e[i].alias(f"e{i}") for i in n])
        return F.struct(F.struct(*[e[i].alias(f"p{i}") for i in n]).alias("prev"), F.concat(acc["out"], F.array(row)).alias("out"))

    def block(acc, part):
        done = F.aggregate(part, F.struct(acc["prev"].alias("prev"), F.array().cast(f"array<{one}>").alias("out")), step)
        return F.element_at(F.transform(F.array(done), lambda r: F.struct(
            r["prev"].alias("prev"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), 1)

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_h"))).cast("int"))
    hist = hist.withColumn("_w", width)
    parts = F.transform(F.sequence(F.lit(1), F.size("_h"), F.col("_w")), lambda i: F.slice("_h", i, F.col("_w")))
    empty = F.struct(start.alias("prev"), F.array().cast(f"array<array<{one}>>").alias("out"))
    folded = hist.select(*keys, F.flatten(F.aggregate(parts, empty, block)["out"]).alias("_o"))
    flat = folded.select(*keys, F.inline("_o"))
    return flat.select(*keys, F.col("o").alias(order), *[F.col(f"e{i}").alias(m.out) for i, m in enumerate(emas)])


def ema_fold(df: DataFrame, keys: Sequence[str], order: str, value: str, beta: float,
             seed: str | float = "first", clamp: tuple[float, float] | None = None,
             out: str = "ema", init_state: DataFrame | None = None) -> DataFrame:
    """:func:`ema_folds` of one statistic; ``init_state`` is (keys, prev)."""
    init = init_state.withColumnRenamed("prev", out) if init_state is not None else None
    return ema_folds(df, keys, order, [Ema(value, beta, out, seed, clamp)], init)


def ema_last(folded: DataFrame, keys: Sequence[str], order: str, out: str = "ema") -> DataFrame:
    """The state to carry forward: each key's EMA at its latest step."""
    return folded.groupBy(*keys).agg(F.max_by(out, order).alias("prev"), F.max(order).alias(order))


# ---- prefix scan over clamped affine maps

_MAP = "struct<cut:boolean,s:double,a:double,b:double,lo:double,hi:double>"


def _bounded(x: Column, lo: Column, hi: Column) -> Column:
    """x within bounds, of which a null one is none; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def _step_map(m: Ema, v: Column) -> Column:
    """The map of one step: ``s`` is the state if there was none before, and
    ``cut`` says that the state before does not matter (a null value)."""
    lo, hi = (F.lit(None).cast("double"),) * 2 if m.clamp is None else (F.lit(float(m.clamp[0])), F.lit(float(m.clamp[1])))
    first = v if m.seed == "first" else F.when(v.isNotNull(), F.lit(float(m.seed)))
    return F.struct(v.isNull().alias("cut"), _bounded(ema_update(first, v, m.beta), lo, hi).alias("s"), F.lit(float(m.beta)).alias("a"),
                    (F.lit(1.0 - m.beta) * F.coalesce(v, F.lit(0.0))).alias("b"), lo.alias("lo"), hi.alias("hi")).cast(_MAP)


def _apply(m: Column, x: Column) -> Column:
    """The state after the map ``m`` from the state ``x`` (null: none)."""
    return F.when(m["cut"] | x.isNull(), m["s"]).otherwise(_bounded(m["a"] * x + m["b"], m["lo"], m["hi"]))


def _then(f: Column, g: Column) -> Column:
    """First f, then g, as one map."""
    limit = lambda bound: F.when(bound.isNull(), None).otherwise(_bounded(g["a"] * bound + g["b"], g["lo"], g["hi"]))
    # without a bound of f the bound of g stays; one of f is carried through g
    lo, hi = F.coalesce(limit(f["lo"]), g["lo"]), F.coalesce(limit(f["hi"]), g["hi"])
    return F.struct((f["cut"] | g["cut"]).alias("cut"), _apply(g, f["s"]).alias("s"), (f["a"] * g["a"]).alias("a"),
                    (g["a"] * f["b"] + g["b"]).alias("b"), lo.alias("lo"), hi.alias("hi")).cast(_MAP)


def _scan(elems: DataFrame, keys: list[str], k: int, init: DataFrame | None, block: int, parts: int) -> DataFrame:
    """The elements (keys, o, m: array of k maps), of which ``o`` gives the order
    in a key, with ``at``: the k states before each."""
    # in the order of keys and o, in pieces of any size; row numbers go on within a piece
    placed = write_once(elems.repartitionByRange(parts, *keys, "o").sortWithinPartitions(*keys, "o")
                        .withColumn("_id", F.monotonically_increasing_id()), "scan_elements")
    slot = F.col("_id") - F.pmod(F.col("_id").bitwiseAND((1 << 33) - 1), F.lit(block))
    groups = placed.groupBy(*keys, slot.alias("_slot")).agg(
        F.min("_id").alias("_b"), F.array_sort(F.collect_list(F.struct("o", "m"))).alias("h"))
    tail = F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0)))
    whole = F.aggregate(tail, F.get("h", F.lit(0))["m"], lambda acc, e: F.array(*[_then(acc[i], e["m"][i]) for i in range(k)]))
    blocks = write_once(groups.select(*keys, "_b", "h", whole.alias("m")), "scan_blocks")
    heads = blocks.select(*keys, F.col("_b").alias("o"), "m")
    most = heads.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > block:
        starts = _scan(heads, keys, k, init, block, parts)
    else:
        rows = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "m"))).alias("h"))
        none = F.array(*[F.lit(None).cast("double")] * k)
        if init is not None:
            prev = init.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("at").alias("_at"))
            rows = rows.join(prev, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left")
            none = F.coalesce("_at", none)
        starts = rows.withColumn("at", none).select(F.inline(_before("h", k)))
    # a block's number is that of its first element, so it is unique over all keys
    j = blocks.drop("m").join(starts.select(F.col("o").alias("_b"), "at"), "_b")
    return j.select(*keys, F.inline(_before("h", k)))


def _before(h: str, k: int) -> Column:
    """For the list ``h`` of (o, m) and the states ``at`` before its first, an
    array of (o, m, at) with the states before each."""
    n = range(k)
    one = f"struct<o:bigint,m:array<{_MAP}>,at:array<double>>"
    start = F.struct(F.col("at").alias("x"), F.array().cast(f"array<{one}>").alias("out"))

    def step(acc, e):
        row = F.struct(e["o"].alias("o"), e["m"].alias("m"), acc["x"].alias("at"))
        return F.struct(F.array(*[_apply(e["m"][i], acc["x"][i]) for i in n]).alias("x"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(h, start, step)["out"]


def ema_scan(df: DataFrame, keys: Sequence[str], order: str, emas: Sequence[Ema], init_state: DataFrame | None = None,
             block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """As :func:`ema_folds`, for histories of any length: no task holds more than
    ``block`` steps of a key at a time, and a key with all the steps is worked on
    by all tasks.  (key, order) is unique."""
    keys, n = list(keys), range(len(emas))
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = df.select(*keys, F.col(order).cast("bigint").alias("o"),
                  F.array(*[_step_map(m, F.col(m.value).cast("double")) for m in emas]).alias("m"))
    init = None
    if init_state is not None:
        init = init_state.select(*keys, F.array(*[F.col(m.out).cast("double") for m in emas]).alias("at"))
    done = _scan(e, keys, len(emas), init, block, parts)
    return done.select(*keys, F.col("o").alias(order), *[_apply(F.col("m")[i], F.col("at")[i]).alias(emas[i].out) for i in n])
