import random
from collections import defaultdict

from cartoflux.llm.mixing import ORACLE_SQL, mix, op3_mixing, with_targets
from cartoflux.llm.url_filter import RULES, filter_urls

SCHEMA = "doc_id long, text string, source string, taken string"


def water_fill(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while True:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= set(over)
        left = sum(sizes.values()) - sum(target.values())


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 10, 500, 90_000]) for i in range(n)}
        found = with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water_fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
        for row in found:
            assert abs(row.target - want[row.source]) < 1e-6 * max(1, want[row.source])


def test_mix_is_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "a", "a", "b", "c", "d", None]), "clash") for i in range(4000)]
    rows += [(4001, None, "a", "x"), (4002, "", "b", "x"), (4003, "w " * 7, "a", "x"), (4003, "w " * 7, "a", "x")]
    found = mix(spark.createDataFrame(rows, SCHEMA))
    assert len(got := found.collect()) == len(rows)
    assert sorted(got, key=str) == sorted(mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=str)
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)


def test_chances_differ_by_length(spark):
    """Within a source longer documents are wanted more often; copies taken follow what is wanted."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([3, 30, 300]), "a" if i % 3 else "b", "x") for i in range(3000)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {r[0]: r[2] for r in rows}
    for s in "ab":
        mean = {}
        for size in (3, 30, 300):
            of = [r.taken / size for r in found if source[r.doc_id] == s and r.size == size]
            mean[size] = sum(of) / len(of)
        bits = {n: n.bit_length() for n in mean}
        # taken per bit of size is one rate, but for what is capped at three copies
        rate = mean[300] / bits[300]
        assert mean[3] < mean[30] <= mean[300] and all(abs(mean[n] - min(3, rate * bits[n])) < 0.12 for n in mean)
        taken = sum(r.taken for r in found if source[r.doc_id] == s)
        assert abs(taken - next(r.target for r in found if source[r.doc_id] == s)) <= 300


def test_documents_that_do_not_fit_are_passed_over(spark):
    """Some documents are longer than what is due when their turn comes: shorter ones behind them fill the mix."""
    rng = random.Random(9)
    for seed in range(3):
        rows = [(100 * seed + i, "w " * rng.choice([1, 2, 5, 9, 30, 80]), "ab"[i % 2], "x") for i in range(300)] + [(100 * seed + 300 + i, "w " * 900, "ab"[i % 2], "x") for i in range(6)]
        found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
        source = {r[0]: r[2] for r in rows}
        for s in "ab":
            of = [r for r in found if source[r.doc_id] == s]
            assert abs(sum(r.taken for r in of) - of[0].target) <= 0.02 * of[0].target


def test_the_mixes_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE_SQL)
    got = op3_mixing(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_no_documents(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    only = mix(spark.createDataFrame([(1, None, None, "x"), (2, "", "s", "x")], SCHEMA)).collect()
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2


def judge(url, rules):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:end].translate({i: i + 32 for i in range(65, 91)})
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), default=None)
    return host, path, best and best[0], best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(3)
    parts = ["net", "example", "com", "org", "EXAMPLE", "x", "", "é"]
    urls = [None, "", "http://", "no scheme", "://net", "http://net/", "http://net", "http://NET/a?b#c", "a://b://net/", "http://xnet/", "http://a.net?x=/"]
    for _ in range(3000):
        host = ".".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        urls.append(f"http://{host}" + "".join("/" + rng.choice(["en", "de", "fr", "a", "", "english"]) for _ in range(rng.randrange(4))) + rng.choice(["", "/", "?q=/en/", "#f"]))
    more = [("x.org/e", "x.org", "/e", "block"), ("com", "com", "", "block"), ("example.com/de/a/", "example.com", "/de/a/", "allow")]
    for rules in (RULES, RULES + more, []):
        pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
        found = filter_urls(pages, spark.createDataFrame(rules, "rule string, host string, path string, verdict string")).collect()
        assert len(found) == len(urls)
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules), urls[r.page_id]


def test_urls_repeat(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")] * 3 + [(1, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES + RULES, "rule string, host string, path string, verdict string")
    assert sorted(str(r.rule) for r in filter_urls(pages, rules).collect()) == ["None", "net/", "net/", "net/"]
    assert filter_urls(pages.limit(0), rules).collect() == []
