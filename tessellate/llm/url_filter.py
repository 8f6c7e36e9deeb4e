"""Operator 6: URL filters from pattern rules, with DataFrame and SQL functions
only.

A rule is a pattern in the common filter-list notation: ``||`` anchors at a
host name or one of its subdomains, ``|`` at an end of the address, ``^`` is a
separator, ``*`` anything; a pattern without anchor fits anywhere.  Rules are a
table (or a short list); Spark makes their regular expressions and literal
tokens.  Each rule is indexed under the rarest of its literal tokens, rarity
being the number of addresses of the table that hold the token.  Addresses fetch
candidate rules by their own tokens and only those run their regular expression.
A rule without a whole literal token is a candidate for every address.  A small
index is broadcast; a larger one meets the addresses in a shuffle, in which a
token that many addresses have is dealt in as many shares as it needs.

Defined results.  A null address, or one without ``://``, has empty host and
path, fits no rule and is allowed.  Repeated rows and null page ids are judged
one by one.  Among rules that fit, listed rules go before the method's
patterns, then the longest wins (then the last in text order).  An empty table
gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, materialise

#: The rules that the task lists.
LISTED = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The method's own patterns, for addresses that no listed rule fits.
PATTERNS = (
    ("-pills.", "block"), ("-pills^", "block"), ("-bets.", "block"), ("-bets^", "block"), ("-loans.", "block"),
    ("-casino.", "block"), ("||casino.", "block"), ("/casino/", "block"), ("||xxx.", "block"), ("/porn/", "block"),
    ("/viagra^", "block"), ("/wp-admin/", "block"), ("/wp-login.", "block"), ("/cgi-bin/", "block"), ("/login^", "block"),
    ("/cart^", "block"), ("/checkout^", "block"), ("/signup^", "block"), (".exe|", "block"), (".zip|", "block"), (".apk|", "block"),
    ("||ads.", "block"), ("||adserver.", "block"), ("/ads/", "block"), ("||doc.*/login^", "allow"), ("/docs/login^", "allow"),
)
#: An index of at most this many rules is broadcast, a larger one shuffled.
MAX_BROADCAST_RULES = 100_000
#: A token is dealt in shares when it makes up more than this part of all tokens.
SHARE = 1000
_TOKEN = "[a-z0-9%]+"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    listed: bool = False

    def pattern(self) -> str:
        return f"||{self.text}" if self.listed else self.text

    def regex(self) -> str:
        """Over ``//host/path?query#fragment``."""
        p = self.pattern()
        head, tail = "", ""
        if p.startswith("||"):
            head, p = r"^//(?:[^/?#]*\.)?", p[2:]
        elif p.startswith("|"):
            head, p = "^//", p[1:]
        if p.endswith("|"):
            tail, p = "$", p[:-1]
        parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|$)"}
        return ("" if self.listed else "(?i)") + head + "".join(parts.get(c) or re.escape(c) for c in p) + tail

    def tokens(self) -> list[str]:
        """Literal tokens that any address with this pattern holds whole: bounded
        on both sides by a literal non-token character, separator or anchor."""
        p = self.pattern().lower()
        left_open, right_open = not p.startswith("|"), not p.endswith("|")
        p = p.strip("|")
        out = []
        for m in re.finditer(_TOKEN, p):
            left = p[m.start() - 1] != "*" if m.start() else not left_open
            right = p[m.end()] != "*" if m.end() < len(p) else not right_open
            if left and right:
                out.append(m[0])
        return sorted(set(out))


DEFAULT_RULES = tuple(Rule(t, v, True) for t, v in LISTED) + tuple(Rule(t, v) for t, v in PATTERNS)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``rule, verdict, listed`` of a short list of :class:`Rule`, as literals of the
    plan; long lists come as a table."""
    rows = [F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<rule:string,verdict:string,listed:boolean>>")))


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rule, verdict, listed, regex, literals`` of a table of rules (``listed``
    may be missing: false); null and repeated rules go.  As
    :meth:`Rule.regex` and :meth:`Rule.tokens`."""
    listed = F.coalesce(F.col("listed"), F.lit(False)) if "listed" in rules.columns else F.lit(False)
    r = rules.select("rule", "verdict", listed.alias("listed")).filter(F.col("rule").isNotNull()).dropDuplicates()
    p = F.when(F.col("listed"), F.concat(F.lit("||"), "rule")).otherwise(F.col("rule"))
    host, start = p.startswith("||"), p.startswith("|")
    core = F.regexp_replace(p, r"^\|\|?", "")
    end = core.endswith("|")
    core = F.when(end, F.regexp_replace(core, r"\|$", "")).otherwise(core)
    # ASCII signs but * and ^ stand for themselves
    plain = F.regexp_replace(core, r"([!-)+-/:-@\[-\]_`{-~])", r"\\$1")
    body = F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^a-zA-Z0-9_.%-]|$)"))
    head = F.when(host, F.lit(r"^//(?:[^/?#]*\.)?")).when(start, F.lit("^//")).otherwise("")
    regex = F.concat(F.when(F.col("listed"), F.lit("")).otherwise("(?i)"), head, body, F.when(end, F.lit("$")).otherwise(""))
    # an open side may go on with the same token, as beside a *
    side = lambda anchored: F.when(anchored, F.lit(" ")).otherwise("*")
    bounded = F.concat(side(start), F.lower(F.regexp_replace(p, r"^\|+|\|+$", "")), side(end))
    literals = F.array_distinct(F.regexp_extract_all(bounded, F.lit(r"(?<![a-z0-9%*])[a-z0-9%]+(?![a-z0-9%*])"), F.lit(0)))
    return r.select("rule", "verdict", "listed", regex.alias("regex"), literals.alias("literals"))


def address(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``__host``, ``__path``, ``__address`` and ``__tokens``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    d = pages.withColumn("__rest", rest)
    d = d.withColumn("__host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER))
    after = F.substring(F.col("__rest"), F.length("__host") + 1, F.length("__rest"))
    d = d.withColumn("__after", after).withColumn("__path", F.regexp_extract("__after", r"^[^?#]*", 0))
    d = d.withColumn("__address", F.when(F.col("__rest") != "", F.concat(F.lit("//"), "__host", "__after")).otherwise(""))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("__address"), F.lit(_TOKEN), 0))
    return d.withColumn("__tokens", F.when(F.col("__address") != "", F.array_union(F.array(F.lit("")), tokens)).otherwise(F.array().cast("array<string>")))


def token_counts(addresses: DataFrame) -> DataFrame:
    """``token, n``: the addresses that hold each token."""
    return addresses.select(F.explode("__tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def index_rules(seen: DataFrame, rules: DataFrame) -> DataFrame:
    """The compiled ``rules`` with ``token``: the literal held by the fewest
    addresses (``seen``: as by :func:`token_counts`), or the empty token, which
    every address has."""
    per_rule = rules.select("rule", "verdict", "listed", "regex", F.explode_outer("literals").alias("token"))
    ranked = per_rule.join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    return ranked.groupBy("rule", "verdict", "listed", "regex").agg(rarest.alias("r")).select(
        "rule", "verdict", "listed", "regex", F.col("r.token").alias("token"))


def _candidates(tokens: DataFrame, index: DataFrame, seen: DataFrame) -> DataFrame:
    """``tokens`` (rows with ``token``) joined with their rules of an index too
    large to be broadcast.  Fewer than ``SHARE`` tokens are common, by counting;
    their rows are dealt in shares, and each share gets the token's rules."""
    most = (seen.agg(F.sum("n")).first()[0] or 0) // SHARE + 1
    common = F.broadcast(seen.filter(F.col("n") > most).select("token", F.ceil(F.col("n") / most).cast("int").alias("__shares")))
    one = F.coalesce("__shares", F.lit(1))
    left = tokens.join(common, "token", "left").withColumn("__share", F.pmod(F.xxhash64("__row"), one).cast("int"))
    right = index.join(common, "token", "left").withColumn("__share", F.explode(F.sequence(F.lit(0), one - 1)))
    return left.drop("__shares").join(right.drop("__shares"), ["token", "__share"])


def judge(pages: DataFrame, rules=DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, pattern, verdict`` of every row; ``rule`` is the
    listed rule that decided, ``pattern`` the method's.  ``rules`` are a DataFrame
    (rule, verdict and, if wanted, listed) or a list of :class:`Rule`."""
    a = address(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    a = materialise(a.select("page_id", "__host", "__path", "__address", "__tokens", F.monotonically_increasing_id().alias("__row")), "addresses")
    rules = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    seen = materialise(token_counts(a), "token-counts")
    index = materialise(index_rules(seen, compile_rules(rules)), "rule-index")
    tokens = a.select("__row", "__address", F.explode("__tokens").alias("token"))
    if index.count() <= MAX_BROADCAST_RULES:
        pairs = tokens.join(F.broadcast(index), "token")
    else:
        pairs = _candidates(tokens, index, seen)
    fits = pairs.filter(F.rlike(F.col("__address"), F.col("regex")))
    best = fits.groupBy("__row").agg(F.max(F.struct("listed", F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    out = a.select("__row", "page_id", "__host", "__path").join(best, "__row", "left")
    return out.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"),
                      F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
                      F.when(~F.col("best.listed"), F.col("best.rule")).alias("pattern"),
                      F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _duckdb_oracle() -> str:
    values = ", ".join(f"('{r.text}', '{r.verdict}', {str(r.listed).lower()}, '{r.regex()}')" for r in DEFAULT_RULES)
    return rf"""
WITH rules(rule, verdict, listed, regex) AS (VALUES {values}),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, row_number() OVER () AS r, rest,
             translate(regexp_extract(rest, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host FROM a),
c AS (SELECT *, substr(rest, length(host) + 1) AS after FROM b),
f AS (SELECT r, rule, verdict, listed, row_number() OVER (PARTITION BY r ORDER BY listed DESC, length(rule) DESC, rule DESC) AS k
      FROM c JOIN rules ON rest <> '' AND regexp_matches('//' || host || after, regex))
SELECT c.page_id, host, regexp_extract(after, '^[^?#]*') AS path, CASE WHEN listed THEN rule END AS rule,
       CASE WHEN NOT listed THEN rule END AS pattern, coalesce(verdict, 'allow') AS verdict
FROM c LEFT JOIN f ON f.r = c.r AND f.k = 1
"""


ORACLE = _duckdb_oracle()
