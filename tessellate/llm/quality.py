"""Operator 1: quality rules as a learned decision list, with DataFrame and SQL
functions only.

Statistics of each whole text are taken once and written to the shared folder.
From those of labelled documents, sequential covering learns rules for low
quality: a rule grows by the threshold with the best information gain on one
part of the rows, is pruned to the prefix with the best (p - n) / (p + n) on
the other part, and is accepted if it is precise enough there; the rows it
covers leave and the next rule is learned.  Each step is one aggregation to a
histogram of (statistic, bin, label), whose size is fixed; only histograms
reach the driver.  The list becomes one ordered conditional expression.

Defined results.  A null or empty text has no words, lines or symbols, so it
fails the base rule (fewer than 10 words).  Repeated rows get one verdict each.
Labels with a null quality or id, or of the held-out fold, are not learned
from; a document with conflicting labels counts as low quality.  Without low
labels the list is empty and keeps what the base rule keeps.  Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, let, materialise

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Statistics that rules test.
TESTED = ("n_words", "mean_word", "symbol_ratio", "upper_ratio", "digit_ratio", "punct_ratio",
          "dup_line_ratio", "repeat_ratio", "distinct_ratio")
THRESHOLDS = 32
MAX_RULES, MAX_CONDITIONS = 8, 4
#: A rule is accepted if it is right this often on the pruning part, on this many rows.
PRECISION, SUPPORT = 0.95, 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or
    more.  Windows are compared by 64-bit hashes; only texts with two equal
    hashes are sorted."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(p, lambda x, i: F.when((i > 0) & same(x, i - 1) | (i < last) & same(x, i + 1), x["i"]))
            return F.sort_array(F.array_compact(marked))

        start = F.struct(F.lit(-window).alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(let(pairs, places), start,
                           lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(window), x - acc["at"])).alias("n")),
                           lambda acc: acc["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window),
                             lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))

    return F.when(F.size(words) >= window, let(words, count)).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row of ``docs``, with ``base_failed``."""
    only = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("bigint")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^ \t-\r]"))
    d = d.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", r"[ \t-\r]+", "")).cast("bigint").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"), only(r"\p{Lu}").alias("n_upper"), only("0-9").alias("n_digits"),
        only(".,;:!?").alias("n_punct"),
        let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        "n_upper", "n_digits", "n_punct", F.col("lines.n").cast("bigint").alias("n_lines"), "n_distinct",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))


def tested(name: str) -> Column:
    """A statistic that rules test, as a double."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"), "upper_ratio": per("n_upper", "word_chars"),
        "digit_ratio": per("n_digits", "word_chars"), "punct_ratio": per("n_punct", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"),
        "distinct_ratio": per("n_distinct", "n_words"),
    }[name]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # > threshold, else <= threshold
    threshold: float
    bin: int = field(compare=False, default=0)

    def on_bins(self) -> Column:
        at = F.col("bins")[TESTED.index(self.name)]
        return at > self.bin if self.above else at <= self.bin

    def on_statistics(self) -> Column:
        return tested(self.name) > self.threshold if self.above else tested(self.name) <= self.threshold

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, precision: float = PRECISION, support: int = SUPPORT) -> list[list[Condition]]:
    """Rules for ``low`` (boolean) from rows of :func:`statistics` with that column."""
    grid = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    stats = labelled.select("doc_id", "low", *[tested(n).alias(f"t_{n}") for n in TESTED])
    # thresholds from both classes, so that a rare class has its own
    cuts = {n: set() for n in TESTED}
    for row in stats.groupBy("low").agg(*[F.percentile_approx(f"t_{n}", grid, 2000).alias(n) for n in TESTED]).collect():
        for n in TESTED:
            cuts[n].update(row[n] or [])
    cuts = {n: sorted(v) for n, v in cuts.items()}
    if not any(cuts.values()):
        return []
    # bin b holds the values with b thresholds below them: value <= cuts[b], > cuts[b - 1]
    below = lambda n: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: c < F.col(f"t_{n}")))
    bins = F.array(*[below(n) for n in TESTED])
    prune = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(3)) == 0
    rows = materialise(stats.select(bins.alias("bins"), "low", prune.alias("prune")).groupBy("bins", "low", "prune")
                       .agg(F.count(F.lit(1)).alias("n")), "quality-bins")
    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < max_rules:
        rule = _prune(left, _grow(left, cuts), precision, support)
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~_all([c.on_bins() for c in rule]))
    return _centred(stats, rules)


def _centred(stats: DataFrame, rules: list[list[Condition]]) -> list[list[Condition]]:
    """Thresholds in the middle of the gap between the labelled values around them."""
    flat = [c for r in rules for c in r]
    if not flat:
        return []
    ends = []
    for i, c in enumerate(flat):
        at = F.col(f"t_{c.name}")
        ends += [F.max(F.when(at <= c.threshold, at)).alias(f"lo{i}"), F.min(F.when(at > c.threshold, at)).alias(f"hi{i}")]
    got = stats.agg(*ends).first()
    middle = iter([replace(c, threshold=(got[f"lo{i}"] + got[f"hi{i}"]) / 2) if got[f"lo{i}"] is not None and got[f"hi{i}"] is not None else c
                   for i, c in enumerate(flat)])
    return [[next(middle) for _ in r] for r in rules]


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    part = rows.filter("not prune")
    while len(rule) < MAX_CONDITIONS:
        counts = (part.select("low", "n", F.posexplode("bins").alias("stat", "bin")).groupBy("stat", "bin", "low")
                  .agg(F.sum("n").alias("n")).collect())
        table: dict[int, dict[int, list[int]]] = {}
        for r in counts:
            table.setdefault(r["stat"], {}).setdefault(r["bin"], [0, 0])[bool(r["low"])] += r["n"]
        if not table:
            break
        all_n, all_p = (sum(v[k] for v in table[0].values()) for k in (0, 1))
        if not all_p or not all_n:
            break
        base, best = log2(all_p / (all_p + all_n)), (1e-9, None)
        for stat, by_bin in sorted(table.items()):
            n = p = 0
            for b, cut in enumerate(cuts[TESTED[stat]]):
                n, p = n + by_bin.get(b, [0, 0])[0], p + by_bin.get(b, [0, 0])[1]
                for above, q, m in ((False, p, n), (True, all_p - p, all_n - n)):
                    gain = q * (log2(q / (q + m)) - base) if q else 0.0
                    if gain > best[0]:
                        best = (gain, Condition(TESTED[stat], above, float(cut), b))
        if best[1] is None:
            break
        rule.append(best[1])
        part = part.filter(best[1].on_bins())
    return rule


def _prune(rows: DataFrame, rule: list[Condition], precision: float, support: int) -> list[Condition]:
    if not rule:
        return []
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all([c.on_bins() for c in rule[:k]])
        sums += [F.sum(F.when(hit & F.col("low"), F.col("n"))).alias(f"p{k}"), F.sum(F.when(hit & ~F.col("low"), F.col("n"))).alias(f"n{k}")]
    got = rows.filter("prune").agg(*sums).first()
    worth = [((p - n) / (p + n), -k, p / (p + n), p + n) for k in range(1, len(rule) + 1)
             if (p := got[f"p{k}"] or 0) + (n := got[f"n{k}"] or 0)]
    if not worth:
        return []
    _, k, right, rows_hit = max(worth)
    return rule[:-k] if right >= precision and rows_hit >= support else []


def rule_number(rules: list[list[Condition]]) -> Column:
    """The ordered conditional expression: number of the first rule that fires
    (from 1), null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_all([c.on_statistics() for c in rules[k - 1]]), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (text of the rule that fired) and ``kept``."""
    stats = materialise(statistics(docs, id_col, text_col), "quality-statistics")
    marks = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.min("quality") == 0).alias("low")))
    # the base rule comes first in the list, so the learned ones see what it leaves
    rules = learn(stats.filter(~F.col("base_failed")).join(marks, "doc_id"))
    number = rule_number(rules)
    names = F.array(*[F.lit(" and ".join(map(str, r))) for r in rules]) if rules else F.array().cast("array<string>")
    return stats.withColumn("rule", F.when(~F.col("base_failed"), F.get(names, number - 1))).withColumn(
        "kept", ~F.col("base_failed") & number.isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with base statistics and verdict."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
