import random
import re
from itertools import combinations

from tickframe.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/en", "http://net/x", "http://planet/x",
        "http://x.net", "http://x.net?q=/en/", "http://example.com/de/1", "http://www.EXAMPLE.com/de/1#f", "http://example.com/deutsch",
        "http://a.org/fr/1", "http://a.org/en/1", "x://a://b/c", "http://É.net/"]


def brute(url):
    """host, path, rule, verdict of the given rules."""
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_given_rules_same_as_brute_force(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(4, URLS[4], "x"), (None, "http://a.net/", "x")],
                               "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect())
    want = []
    for k, u in [*enumerate(URLS), (4, URLS[4]), (None, "http://a.net/")]:
        host, path, rule = brute(u)
        want.append((str(k), host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow"))
    assert got == sorted(want, key=lambda t: t[:3])


def test_mined_rules_reach_unlabelled_urls(spark):
    urls = [f"http://spam.s{k}.net/p/{k}" for k in range(60)] + [f"http://good.g{k}.com/p/{k}" for k in range(60)]
    urls += ["http://spam.other.com/q/1", "http://good.other.com/q/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in U.judge(df, min_support=0.05, min_confidence=0.9).collect()}
    assert got[120].verdict == "block" and got[120].rule is None and got[120].mined_rule == "h:spam"
    assert got[121].verdict == "allow" and all(got[k].verdict == "allow" for k in range(60, 120))


def test_no_pages(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_long_templates_are_mined_as_one(spark):
    """Shared path parts would give two to the power of their number of combinations; few URLs would be their own."""
    template = "/".join(f"part{k}" for k in range(30))
    urls = [f"http://h{k}.net/{template}/{k}" for k in range(150)] + [f"http://h{k}.com/" + "/".join(f"u{k}x{j}" for j in range(40)) for k in range(50)]
    urls += [f"http://other.com/{template}/x", "http://other.com/" + "long" * 3000]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[200].rule is None and got[200].verdict == "block" and got[201].verdict == "allow"
    assert all(got[k].verdict == "block" for k in range(150)) and all(got[k].verdict == "allow" for k in range(150, 200))


def test_mined_rules_same_as_brute_force(spark):
    """Support and confidence of every combination counted one by one; rules of shorter ones as sure are all that is left."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        toks = sorted({f"p:t{rng.randrange(6)}" for _ in range(rng.randrange(1, 5))} | {f"p:only{k}"})
        verdict = rng.choice([None, "allow"]) if "p:t1" not in toks else rng.choice(["block"] * 12 + ["allow"])
        rows.append((k, toks, verdict))
    made = {(tuple(r.need), r.verdict): (round(r.confidence, 9)) for r in U.mine(
        spark.createDataFrame(rows, "id long, tokens array<string>, verdict string"), 0.05, 0.9).collect()}
    want = {}
    for size in (1, 2, 3, 4):
        for need in combinations([f"p:t{k}" for k in range(6)], size):
            fit = [v for _, t, v in rows if set(need) <= set(t)]
            for verdict in ("allow", "block"):
                both = fit.count(verdict)
                if both >= 15 and both >= 0.9 * len(fit):
                    want[need, verdict] = round(both / len(fit), 9)
    pruned = {(n, v): c for (n, v), c in want.items() if not any(
        set(m) < set(n) and w == v and c2 >= c for (m, w), c2 in want.items())}
    assert made == pruned and pruned
