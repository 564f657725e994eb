"""URL filter: parsing and rules against plain code, the model on held-back URLs."""

import math
import random
import re

from textloom.llm.url_filter import A, ALPHABET, RULES, _Markov, filter_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fitting = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else (None, None)


def urls():
    draw = random.Random(5)
    hosts = ["example.com", "EXAMPLE.com", "a.example.com", "notexample.com", "example.net", "x.net", "net", "y.org", "com", "", "ünï.com"]
    paths = ["", "/", "/en/7", "/en/71?x", "/en/8", "/de/", "/de/8#z", "/es/q", "/EN/7", "?a/en/", "#/en/", "/en"]
    rows = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(400)]
    return [*rows, None, "", "no scheme.com/en/", "://", "a://b://c/en/", "http://x.com/en/\nline", "http://" + "z" * 20_000 + ".com/en/", "/p?u=http://q.org/es/"]


def test_parsing_and_rules(spark):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in rows], "page_id long, url string, html string, rule string")
    found = filter_urls(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = parts(rows[r["page_id"]][1])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_model_parts_what_no_rule_decides(spark):
    draw = random.Random(1)
    good = [f"https://site{draw.randrange(50)}.net/de/article-{draw.choice(['science', 'history', 'garden'])}-{k}" for k in range(300)]
    bad = [f"https://win{draw.randrange(50)}.com/en/casino-{draw.choice(['bonus', 'poker', 'xxx'])}-{k}" for k in range(300)]
    other = [(f"https://news{k}.info/article-history-garden-{k}", "allow") for k in range(40)] + [(f"https://win{k}.biz/casino-poker-bonus-{k}", "block") for k in range(40)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*good, *bad, *(u for u, _ in other)])], "page_id long, url string")
    verdict = {r["page_id"]: r["verdict"] for r in filter_urls(pages).collect()}
    right = sum(verdict[600 + k] == want for k, (_, want) in enumerate(other))
    assert right >= 76


def test_probabilities_sum_to_one():
    draw = random.Random(3)
    model = _Markov({draw.randrange(A**4): draw.randrange(1, 9) for _ in range(3000)})
    for order in range(4):
        for _ in range(20):
            context = draw.randrange(A**order)
            assert math.isclose(sum(model.p(order, context * A + c) for c in range(A)), 1, rel_tol=1e-9)
    assert len(ALPHABET) == len(set(ALPHABET)) == 32


def test_edges(spark):
    schema = "page_id long, url string"
    assert filter_urls(spark.createDataFrame([], schema)).count() == 0
    found = filter_urls(spark.createDataFrame([(None, None), (1, "x://a.b/c"), (1, "x://a.b/c")], schema)).collect()
    assert len(found) == 3 and all(r["verdict"] == "allow" and r["rule"] is None for r in found)


def test_the_model_reads_query_and_fragment(spark):
    good = [f"https://a.net/de/x?topic=garden{k}#history" for k in range(200)]
    bad = [f"https://b.com/en/x?ref=casino{k}#poker" for k in range(200)]
    other = [(f"https://c.info/x?topic=garden{k}#history", "allow") for k in range(300, 320)] + [(f"https://c.info/x?ref=casino{k}#poker", "block") for k in range(300, 320)]
    pages = spark.createDataFrame(list(enumerate([*good, *bad, *(u for u, _ in other)])), "page_id long, url string")
    verdict = {r["page_id"]: r["verdict"] for r in filter_urls(pages).collect()}
    assert [verdict[400 + k] for k in range(40)] == [want for _, want in other]
