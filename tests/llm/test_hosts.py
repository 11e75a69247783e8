import random
import re

from quern.llm.hosts import filter_urls
from quern.llm.queries import URL_RULES, op4_url_filter


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = []
    for said, rule in URL_RULES:
        top, rest = rule.split("/", 1)
        if (host == top or host.endswith("." + top)) and path.startswith("/" + rest):
            fit.append((len(rule), rule, said))
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_supplied_pages(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op4_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, said = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and said in (None, r.verdict)


def plain_ranks(edges, seeds, rounds=10, d=0.85):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    nodes = {n for e in edges for n in e} | set(seeds)
    rank = dict(seeds)
    for _ in range(rounds):
        rank = {n: (1 - d) * seeds.get(n, 0) + d * sum(rank.get(a, 0) / len(out[a]) * out[a].count(n) for a in out) for n in nodes}
    return rank


def test_trust_and_distrust_follow_links(spark):
    edges = [("good.com", "mid.org"), ("mid.org", "far.org"), ("bad.org", "spam.net"), ("odd.org", "spam.net"), ("odd.org", "mid.org"), ("mid.org", "far.org"), ("mid.org", "lone.org")]
    pages = [(k, f"http://{a}/en/{k}", f"<A HREF='https://{b}/x'>x</a><a href=/local>y</a>") for k, (a, b) in enumerate(edges)]
    pages += [(20, "http://spam.net/es/1", None), (21, "HTTP://Spam.NET/es/2?q", ""), (22, "http://far.org#x", None), (23, "http://lone.org", None), (24, None, None), (25, "no scheme", "")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in filter_urls(docs, URL_RULES).collect()}
    trust, distrust = plain_ranks(edges, {"good.com": 1.0}), plain_ranks([(b, a) for a, b in edges], {"spam.net": 1.0})
    for r in got.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-9
        want = brute(r.url)[3] or ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) else "allow")
        assert r.verdict == want
    assert got[2].verdict == "block" and got[1].verdict == "allow" and (got[24].host, got[24].path, got[24].rule) == ("", "", None)


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, host int, src string")
    out = filter_urls(pages, URL_RULES)
    assert out.columns == ["page_id", "url", "html", "host", "src", "path", "rule", "verdict", "trust", "distrust"] and out.count() == 0


def test_a_host_with_most_pages_and_many_links(spark):
    """A third of the pages and null urls on hot hosts, links over many hosts; repeated pages count as often as they stand."""
    rng = random.Random(4)
    hosts = [f"h{k}.org" for k in range(60)] + ["good.com", "spam.net"]
    edges, pages = [], []
    for k in range(3600):
        src = "hot.org" if k % 3 == 0 else rng.choice(hosts)
        dst = rng.choice(hosts) if rng.random() < 0.3 else None
        if dst and dst != src:
            edges.append((src, dst))
        path = "/es/" if src == "spam.net" else "/"
        pages.append((k, f"http://{src}{path}{k}", f"<a href=//{dst}/>" if dst else None))
    pages += [(4000 + k, None, None) for k in range(1200)] + [pages[0]] * 3
    edges += [(("hot.org"), dst) for _, _, html in [pages[0]] * 3 if html for dst in [html[10:-2]] if dst != "hot.org"]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    assert len(got) == len(pages)
    trust, distrust = plain_ranks(edges, {"good.com": 1.0}), plain_ranks([(b, a) for a, b in edges], {"spam.net": 1.0})
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-9
        assert r.verdict == (brute(r.url)[3] or ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) else "allow"))


def test_of_equally_long_rules_block_wins(spark):
    rules = [("allow", "a.com/x"), ("block", "a.com/x"), ("block", "b.org/"), ("allow", "b.org/")]
    pages = spark.createDataFrame([(1, "http://a.com/xy", ""), (2, "http://w.b.org/", "")], "page_id long, url string, html string")
    assert {r.verdict for r in filter_urls(pages, rules).collect()} == {"block"}
