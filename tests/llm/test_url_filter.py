import re

import pytest
from pyspark.sql import functions as F

from tessellate.llm import url_filter as U

URLS = ["http://www.example.com/en/1", "https://EXAMPLE.com/en/x?y#z", "http://example.com/en", "http://notexample.com/en/", "http://a.b.example.com/EN/",
        "https://x.net/es/1", "https://x.net/fr/", "https://x.net/de/", "https://net/fr/q", "http://shop.org/cart", "http://shop.org/cart/1?a", "http://shop.org/cartoon",
        "https://cheap-pills.org/", "http://casino.org/", "http://my.casino.example.org/x", "http://x.org/f.exe", "http://x.org/f.exe?x", "http://doc.x.org/login?next",
        "ftp://com/", "http://com", "nothing", "", None, "://", "http://", "http:///path", "http://x.org?q=/cart", "http://x.org/ads/1", "http://x.org/%65n/é", "http://x.com/" + "a/" * 5000]


def _brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    after = rest[len(host):]
    path = re.match(r"[^?#]*", after)[0]
    fits = [(n, v) for n, v in U.LISTED if (low == n.partition("/")[0] or low.endswith("." + n.partition("/")[0])) and path.startswith("/" + n.partition("/")[2])]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
    if rule[0] is None and rest:
        hit = [(len(r.text), r.text, r.verdict) for r in U.DEFAULT_RULES if not r.listed and re.search(r.regex(), "//" + low + after)]
        return low, path, None, max(hit)[2] if hit else "allow"
    return low, path, rule[0], rule[1] or "allow"


def test_every_page_is_judged(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "y"), (0, URLS[0], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, token string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()), key=str)
    assert got == sorted(((i, *_brute(u)) for i, u, _, _ in rows), key=str)
    assert U.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(pages, rules=()).collect()} == {"allow"}


def test_index_takes_the_rarest_whole_literal(spark):
    rules = (U.Rule("||a.example.com/news^", "block"), U.Rule("*part", "block"), U.Rule("/x*tail|", "block"))
    pages = spark.createDataFrame([(i, f"http://a.example.com/{'news' if i == 0 else 'p'}/{i}") for i in range(9)], "page_id bigint, url string")
    a = U.address(pages)
    index = {r.rule: r.token for r in U.index_rules(U.token_counts(a), U.compile_rules(U.rule_table(spark, rules))).collect()}
    assert index["||a.example.com/news^"] == "news" and index["*part"] == ""
    assert rules[2].tokens() == []  # both runs touch the wildcard


ODD_RULES = ["||a-b.example.com^", "|https", "x.(y)+[z]{2}$\\\\w&'\"!#,;:<=>@`~", "a|b", "||", "|", "*", "^", "||é.org/ü^", "/%7Euser/*.html|", "a_b", "*.*", "||x*y|"]


def test_compiled_rules_equal_the_plain_ones(spark):
    rules = U.DEFAULT_RULES + tuple(U.Rule(t, "block") for t in ODD_RULES)
    got = {(r.rule, r.listed): r for r in U.compile_rules(U.rule_table(spark, rules + rules[:3])).collect()}
    assert len(got) == len(rules)
    probes = ["//a-b.example.com/", "//c.a-b.example.com:8/x", "//https", "//x.(y)+[z]{2}$\\\\w&'\"!#,;:<=>@`~", "//q/a|b", "//é.org/ü", "//e/%7Euser/q.html", "//e/a_b", "//x1y",
              "//www.example.com/en/1", "//s.org/cart", "//s.org/f.exe", "//ads.x/"]
    hits = 0
    for r in rules:
        c = got[r.text, r.listed]
        assert sorted(c.literals) == r.tokens()
        d = spark.createDataFrame([(p,) for p in probes], "p string").filter(F.rlike("p", F.lit(c.regex)))
        fit = [p for p in probes if re.search(r.regex(), p)]
        assert sorted(x.p for x in d.collect()) == sorted(fit), r.text
        hits += len(fit)
    assert hits > 30


@pytest.mark.parametrize("broadcast", [True, False])
def test_very_many_rules_from_a_table(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(U, "MAX_BROADCAST_RULES", 10)
        monkeypatch.setattr(U, "SHARE", 20)
    n = 100_000
    rules = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("||host"), F.col("id").cast("string"), F.lit(".com^")))
                                  .when(F.col("id") % 3 == 1, F.concat(F.lit("/page"), F.col("id").cast("string"), F.lit("/*.htm|")))
                                  .otherwise(F.concat(F.lit("||com/x"), F.col("id").cast("string"), F.lit("^"))).alias("rule"),
                                  F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    rows = [(i, f"http://{'www.' * (i % 2)}host{i * 37 % n}.com/page{i * 91 % n}/{'x' * (i % 3)}{i * 53 % n}{'.htm' * (i % 4 > 1)}") for i in range(400)]
    rows += [(1000 + i, f"http://q{i}.com/x{i}/") for i in range(300)]
    got = {r.page_id: (r.pattern, r.verdict) for r in U.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert len(got) == 700 and sum(p is not None for p, _ in got.values()) > 200
    for i, url in rows[::7]:
        rest = url.partition("://")[2]
        host, _, path = rest.partition("/")
        fits = []
        for k in {int(x) for x in re.findall(r"\d+", rest)}:
            if k >= n:
                continue
            text = [f"||host{k}.com^", f"/page{k}/*.htm|", f"||com/x{k}^"][k % 3]
            if re.search(U.Rule(text, "").regex(), "//" + rest):
                fits.append((len(text), text, "block" if k % 2 == 0 else "allow"))
        want = max(fits, default=(0, None, "allow"))
        assert got[i] == want[1:], url
