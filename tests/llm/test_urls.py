import random

from prioscope.llm.urls import RULES, judge_urls, rule_table


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len((h + p).encode()), len(h.encode()), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark, rules), **more).collect()}
    assert found == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    check(
        spark,
        [None, "", "example.com/en/", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/a", "https://example.com", "https://com/", "ftp://x.net/es/1",
         "https://net/fr/", "https://a.b.net/fr", "https://notexample.com/en/", "https://x.com?a=/en/", "://", "http:///en/", "http://É.com/é/ü", "http://a.com/\n?x",
         "http://.com/", "http://x..com/a", "http://example.com/en/" + "p" * 50_000],
        RULES,
    )


def test_random_nested_rules(spark):
    pick = random.Random(5)
    hosts = ["a", "b.a", "c.b.a", "ab.a", "b", "a.b"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/x/y/z"]
    rules = list({(h, p): (h, p, pick.choice(["allow", "block"])) for h, p in ((pick.choice(hosts), pick.choice(paths)) for _ in range(30))}.values())
    urls = [f"http://{pick.choice(['', 'q.'])}{pick.choice(hosts)}{pick.choice(paths)}{pick.choice(['', '?k', '#k', 'w'])}" for _ in range(600)] + ["http://b.a/x"] * 300
    check(spark, urls, rules, per_range=40)


def test_repeated_rows_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.com/", "r", 0), (1, "http://x.com/", "r", 0), (None, None, None, None)], "page_id long, url string, rule string, row int")
    rules = rule_table(spark, RULES)
    assert sorted(map(str, judge_urls(pages, rules).collect())) == sorted(
        ["Row(page_id=1, host='x.com', path='/', rule='com/', verdict='allow')"] * 2 + ["Row(page_id=None, host='', path='', rule=None, verdict='allow')"]
    )
    assert judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.where("false"), "block").collect()} == {"block"}
