import random

import pytest

from loomgraph.llm import urlrules
from loomgraph.llm.urlrules import Rule, judge


def brute(host, path, rules):
    fit = [r for r in urlrules.sorted_rules(rules) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)


@pytest.mark.parametrize("size", [10**6, 3])
def test_like_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(urlrules, "RULES_PER_RANGE", size)
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "a-b", "A", "", "x.y"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: rng.choice(["", "/", "/p", "/p/q", "/p/", "/pq", "/é"])
    rules = [Rule(host(), path(), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = [(i, f"{rng.choice(['http', ''])}://{host()}{path()}{rng.choice(['', '?u=//x', '#://y'])}") for i in range(300)] + [(900, None), (901, "no scheme"), (902, "://"), (903, "a://H\n.b/p\n?x")]
    got = judge(spark.createDataFrame(urls, "page_id long, url string").repartition(3), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        want = brute(r["host"], r["path"], rules)
        assert (r["rule"], r["verdict"]) == ((want.host + want.path, want.verdict) if want else (None, "allow"))
    by = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert by[900] == by[901] == by[902] == ("", "") and by[903] == ("h\n.b", "/p\n")


@pytest.mark.parametrize("urls", [[(1, "x://n7.z/a")], [(i, f"x://s.n{i * 37 % 900}.{'bcz'[i % 3]}/p{i % 7}/q") for i in range(150)]])
def test_sixty_thousand_rules(spark, urls):
    """More rules than one range holds, and ranges without a url."""
    rules = [Rule(f"n{i % 3000}.{'bcz'[i % 3]}", f"/p{i // 3000}", "block") for i in range(60_000)]
    assert len(urlrules.sorted_rules(rules)) > urlrules.RULES_PER_RANGE
    got = judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert len(got) == len(urls)
    for r in got:
        want = brute(r["host"], r["path"], [x for x in rules if r["host"].endswith(x.host)])
        assert (r["rule"], r["verdict"]) == ((want.host + want.path, want.verdict) if want else (None, "allow"))


def test_many_paths_of_one_host():
    rules = urlrules.sorted_rules([Rule("h", "/" + "ab"[i % 2] * (i // 2), "block") for i in range(80)])
    sweep = urlrules.Sweep(rules)
    for path in ("/", "/aaa", "/abab", "/bbbbbbbbbbz", "", "/c", "/" + "a" * 99):
        assert sweep.of(("h",), path) == brute("h", path, rules)


def test_edges(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "k"), (1, "http://a.b/c", "k"), (None, None, None)], "page_id long, url string, rule string")
    assert sorted(r["verdict"] for r in judge(df, [Rule("b", "/", "block")]).collect()) == ["allow", "block", "block"]
    assert judge(df.limit(0), []).count() == 0 and judge(df, []).filter("rule is not null").count() == 0
