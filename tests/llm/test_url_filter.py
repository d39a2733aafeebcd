import re

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import Rule, judge_urls

SCHEMA = "page_id long, url string, html string, host string, trust string"


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fitting(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def by_hand(pages, rules, rounds=8, damping=0.85, least=0.01):
    rows = [(i, *split(u), h) for i, u, h in pages]
    links, good, bad = {}, {}, {}
    for _, host, path, html in rows:
        rule = fitting(host, path, rules)
        if host and rule:
            side = good if rule.verdict == "allow" else bad
            side[host] = side.get(host, 0) + 1
        for target in re.findall(r"""(?is)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
            target = "".join(c.lower() if "A" <= c <= "Z" else c for c in target)
            if host and target != host:
                links[host, target] = links.get((host, target), 0) + 1

    def spread(seeds, edges):
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        start = {h: (1 - damping) * n for h, n in seeds.items()}
        at = dict(start)
        for _ in range(rounds):
            got = {}
            for (a, b), n in edges.items():
                got[b] = got.get(b, 0) + damping * at.get(a, 0) * n / total[a]
            at = {h: got.get(h, 0) + start.get(h, 0) for h in {*got, *start}}
        return {h: round(x, 9) for h, x in at.items()}

    trust, distrust = spread(good, links), spread(bad, {(b, a): n for (a, b), n in links.items()})
    out = []
    for i, host, path, _ in rows:
        rule, d = fitting(host, path, rules), distrust.get(host, 0)
        verdict = rule.verdict if rule else "block" if d >= least and d > trust.get(host, 0) else "allow"
        out.append((i, host, path, rule.text if rule else None, verdict))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def link(*hosts):
    return "".join(f'<a class=x HREF = "https://{h}/p?q">t</a><img src=//{h}/i.png>' for h in hosts)


PAGES = [
    (1, "https://good.org/a", link("Near.net", "near.net", "mid.net")), (2, "http://near.net/x", link("far.net")), (3, "http://far.net", None),
    (4, "http://bad.com/de/x", link("good.org")), (5, "http://farm.net/", link("bad.com", "Bad.com")), (6, "http://farm2.net/en", link("farm.net", "bad.com")),
    (7, "http://mixed.net/q", link("bad.com", "far.net")), (8, "http://bad.com/en/1", ""), (9, "http://A.Example.ORG/es/1?x#y", link("near.net")),
    (10, "http://example.org/en/12", None), (11, "http://example.org/en/2", None), (12, "http://notexample.org/es/", None), (13, "http://org/x", None),
    (14, "http://xcom/fr/", None), (15, "http://b.com/fr/", None), (16, "http://b.com/fr", None), (17, "no scheme/com", None), (18, None, None), (19, "", ""),
    (20, "a://b://c/d", None), (21, "http://h.com?x=/fr/", None), (22, "http://h.org#/x", None), (23, "http://H\u0130.ORG/\nx", None), (24, "://", None),
    (None, "http://mid.net/", link("near.net")), (7, "http://mixed.net/q", link("bad.com", "far.net")), (25, "http://h.org:80/x", None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*p, "h", "t") for p in PAGES], SCHEMA).repartition(3)
    out = judge_urls(df, URL_RULES)
    want = by_hand(PAGES, URL_RULES)
    assert result(out) == want and set(out.columns) == {*df.columns, "path", "rule", "distrust", "verdict"}
    verdicts = {i: v for i, _, _, rule, v in want if rule is None}
    assert verdicts[5] == "block" and verdicts[6] == "block" and verdicts[3] == "allow"


def test_without_links_and_rules(spark):
    pages = [(i, u, None) for i, u, _ in PAGES]
    df = spark.createDataFrame([(*p, "h", "t") for p in pages], SCHEMA)
    assert result(judge_urls(df, URL_RULES)) == by_hand(pages, URL_RULES)
    assert {r.verdict for r in judge_urls(df, []).collect()} == {"allow"}
    assert result(judge_urls(df.limit(0), URL_RULES)) == []


def test_a_hub_and_longer_rules(spark):
    rules = [Rule("allow", "net", "/"), Rule("block", "hub.net", "/a"), Rule("allow", "hub.net", "/ab")]
    pages = [(k, f"http://s{k % 40}.info/", link("hub.net", f"s{k % 7}.info")) for k in range(120)] + [
        (500, "http://hub.net/abc", None), (501, "http://hub.net/ac", None), (502, "http://x.hub.net/", None)]
    df = spark.createDataFrame([(*p, "h", "t") for p in pages], SCHEMA)
    assert result(judge_urls(df, rules)) == by_hand(pages, rules)


def test_native_plan(spark):
    df = spark.createDataFrame([(*p, "h", "t") for p in PAGES], SCHEMA)
    plan = judge_urls(df, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_unrelated_pages_change_no_verdict_and_helper_names_may_clash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*p, "h", "t") for p in PAGES], SCHEMA).withColumn("ruled", F.lit("mine"))
    alone = judge_urls(df, URL_RULES)
    assert {r.ruled for r in alone.collect()} == {"mine"}
    more = spark.range(200_000).select(
        (F.col("id") + 1000).alias("page_id"), F.concat(F.lit("http://u"), F.col("id") % 5000, F.lit(".com/"), F.when(F.col("id") % 3 == 0, "fr").otherwise("de"), F.lit("/x")).alias("url"),
        F.concat(F.lit('<a href="http://u'), F.col("id") % 4999, F.lit('.com/">')).alias("html"), F.lit("h").alias("host"), F.lit("t").alias("trust"), F.lit("mine").alias("ruled"))
    both = judge_urls(df.union(more), URL_RULES)
    assert result(both.where("coalesce(page_id, 0) < 1000")) == result(alone)
