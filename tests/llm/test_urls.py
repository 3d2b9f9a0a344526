import math
import random
from collections import defaultdict

from kinelytics.llm import urls as U

URLS = [
    None, "", "no scheme", "://", "http://", "https://org/", "http://a.org", "http://a.org/x", "http://A.ORG:80/x?q#f", "http://xorg/",
    "http://example.org/es/1", "http://www.example.org/es/", "http://notexample.org/es/", "http://example.org/en/123", "http://example.org/en/2",
    "http://u@b.com/fr/1", "http://b.com/de/1", "http://b.com?x=/de/", "http://b.com#/de/", "ftp://c.net/a?b://d.com/de/", "http://c.net/\n/x", "HTTP://É.com/de/É",
    "http://x.co.uk/en/1", "http://www.shop.com.au/fr/2", "http://co.uk/", "http://com.de/de/1", "http://a.b.org.uk:80/de/3", "http://s.com/de/", "http://t.s.com/de/4",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def ruled(host, path):
    best = None
    for r in U.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


def brute(urls, threshold=0.5, z=1.645):
    parsed = [parse(u) for u in urls]
    rules = [ruled(*p) for p in parsed]
    tree = defaultdict(lambda: [0, 0])
    for (host, _), r in zip(parsed, rules):
        bare = host.rsplit("@", 1)[-1]
        head, _, tail = bare.rpartition(":")
        bare = head if (head or ":" in bare) and (tail.isdigit() or not tail) and ":" in bare else bare
        labels = bare.split(".")
        wide = len(labels) > 1 and labels[-2] in U.SECOND_LEVEL and len(labels[-1]) == 2 and all("a" <= c <= "z" for c in labels[-1])
        domain, suffix = (".".join(labels[-n - wide :]) for n in (2, 1))
        for level in (("h", host, domain, suffix), ("d", domain, suffix), ("s", suffix), ("all",)):
            tree[level][0] += r is not None
            tree[level][1] += r is not None and r.verdict == "block"

    def strength(units):
        w = sum(n * (n - 1) for n, _, _ in units)
        sq = sum(k * (k - 1) - 2 * m * k * (n - 1) + m * m * n * (n - 1) for n, k, m in units)
        mean = sum(m for *_, m in units) / len(units)
        return 1.0 if not w else 1000.0 if sq <= 0 else max(1.0, min(1000.0, mean * (1 - mean) * w / sq - 1))

    n, k = tree[("all",)]
    means = {}
    root = (k + 0.5) / (n + 1)
    posts = {}
    for kind, parent in (("s", lambda t: root), ("d", lambda t: means["s", t[2]]), ("h", lambda t: means["d", t[2]])):
        units = {t: (*v, parent(t)) for t, v in tree.items() if t[0] == kind}
        s = strength(list(units.values()))
        for t, (n, k, m) in units.items():
            a, b = m * s + k, (1 - m) * s + n - k
            means[kind, t[1]] = a / (a + b)
            posts[kind, t[1]] = a, b
    out = []
    for i, ((host, path), r) in enumerate(zip(parsed, rules)):
        a, b = posts["h", host]
        bound = 1 / (1 + math.exp(-(math.log(a / b) - z * math.sqrt(1 / a + 1 / b))))
        out.append((i, host, path, r and r.text, r.verdict if r else "block" if bound >= threshold else "allow", round(bound, 9)))
    return out


def run(spark, urls):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.block_bound, 9)) for r in U.judge(pages).collect())


def test_edge_cases_against_brute_force(spark):
    assert run(spark, URLS) == brute(URLS)


def test_hot_host_and_learned_verdicts(spark):
    r = random.Random(2)
    hosts = [f"h{i}.site{i % 4}.com" for i in range(20)]
    urls = [f"http://hot.com/{r.choice(['de', 'de', 'de', 'en'])}/{i}" for i in range(200)]
    urls += [f"http://{h}/{'de' if int(h.split('site')[1][0]) < 2 and r.random() < 0.9 else r.choice(['fr', 'en'])}/{i}" for i in range(15) for h in hosts]
    got = run(spark, urls)
    assert got == brute(urls)
    free = {(g[1], g[4]) for g in got if g[3] is None}
    assert ("hot.com", "block") in free and any(v == "allow" for _, v in free)


def test_repeated_ids_and_long_urls(spark):
    """Repeated pages are judged one by one; a url of a million characters is read whole."""
    long = "http://long.com/de/" + "x" * 1_000_000
    rows = [(1, "http://a.com/de/1", "x"), (1, "http://a.com/de/1", "x"), (1, "http://b.org/", "y"), (None, long, "z"), (None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = U.judge(pages)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "block_bound"]
    assert sorted((str(r.page_id), r.host, len(r.path), r.verdict) for r in got.collect()) == sorted(
        [("1", "a.com", 5, "block")] * 2 + [("1", "b.org", 1, "allow"), ("None", "long.com", 1_000_004, "block"), ("None", "", 0, brute([r[1] for r in rows])[4][4])]
    )


def test_no_outcomes_and_empty(spark):
    assert {g[4] for g in run(spark, ["http://a.net/x", None, "http://b.net/y"])} == {"allow"}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages).count() == 0


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    plan = U.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
