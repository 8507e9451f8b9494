from opinara.llm import urlfilter

ROWS = [
    (1, "https://Sub.Example.COM/en/7x?q=1#f"),
    (2, "http://example.com/en/8"),
    (3, "http://other.org"),
    (4, "http://a.net/de/1"),
    (5, "http://www.example.net/de/88"),
    (6, None),
    (7, "no scheme/en/"),
    (8, "x://notexample.com/en/7"),
    (8, "http://b.org/es/?a=://c.com/en/"),
    (9, "http://c.com?x=/en/"),
]


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in ROWS], "page_id long, url string, host string, rule string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = [tuple(r)[:5] for r in urlfilter.filter_urls(pages, labelled).orderBy("page_id", "url").collect()]
    assert got == [
        (1, "sub.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "example.com", "/en/8", "com/en/", "block"),
        (3, "other.org", "", None, "allow"),
        (4, "a.net", "/de/1", "net/de/", "allow"),
        (5, "www.example.net", "/de/88", "example.net/de/8", "block"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "b.org", "/es/", "org/es/", "block"),
        (8, "notexample.com", "/en/7", "com/en/", "block"),
        (9, "c.com", "", None, "allow"),
    ]


def wilson(hits, n, z):
    p = hits / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def brute_rules(sets, least, min_confidence, min_lift, z):
    """{tokens: (confidence, support)} from all intersections of bad urls' token sets: the closed itemsets."""
    bad = [frozenset(t) for b, t in sets if b]
    base = len(bad) / len(sets)
    closed, new = set(), set(bad)
    while new - closed:
        closed |= new
        new = {a & b for a in closed for b in set(bad)} - {frozenset()}
    rules = {}
    for c in closed:
        hits, n = sum(c <= t for t in bad), sum(c <= frozenset(t) for _, t in sets)
        sure = wilson(hits, n, z)
        if hits >= least and sure >= min_confidence and sure >= min_lift * base:
            rules[c] = (hits / n, hits / len(sets))
    return rules


def test_mined_rules_match_brute_force(spark):
    rows = [(f"http://good{i % 7}.org/a/{i}?p=1", i % 9 == 0) for i in range(400)] + [(f"http://bad-win{i % 3}.org/play/{i}", i % 10 != 0) for i in range(90)] + [(None, True), ("http://x.org/", None)]
    rows += [("http://good0.org/a/0?p=1", True)] * 40  # one url, many rows: it teaches once
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = urlfilter.mine_rules(labelled, min_support=0.02, min_confidence=0.6).collect()
    votes = {}
    for u, b in rows:
        if u is not None and b is not None:
            votes.setdefault(u, []).append(b)
    urls = spark.createDataFrame([(u, sum(v) * 2 > len(v)) for u, v in votes.items()], "url string, bad boolean")
    sets = [(r.bad, set(r.t)) for r in urls.select("bad", urlfilter.url_tokens(urls.url).alias("t")).collect()]
    want = brute_rules(sets, 20, 0.6, 2.0, urlfilter.Z)
    got = {frozenset(r.tokens): (r.confidence, r.support) for r in rules}
    base = sum(b for b, _ in sets) / len(sets)
    assert got and want
    for c, (confidence, support) in got.items():
        own = [b for b, t in sets if c <= t]
        assert abs(confidence - sum(own) / len(own)) < 1e-12 and abs(support - sum(own) / len(sets)) < 1e-12
        assert sum(own) >= 20 and wilson(sum(own), len(own), urlfilter.Z) >= max(0.6, 2 * base)
        assert not any(d < c and got[d][0] >= confidence for d in got)
    assert all(any(g <= c for g in got) for c in want)  # no combination is missed
    pages = spark.createDataFrame([(1, "http://bad-win1.org/play/5"), (2, "http://good1.org/a/5"), (3, "http://bad-win1.org/play/77"), (4, None), (5, "http://bad-win1.org/play/" + "x/" * 50000)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.n_rules) for r in urlfilter.filter_urls(pages, labelled, rules=(), min_support=0.02, min_confidence=0.6).collect()}
    tokens = {p.page_id: set(p.t) for p in pages.select("page_id", urlfilter.url_tokens(pages.url).alias("t")).collect()}
    for k, t in tokens.items():
        n = sum(set(r.tokens) <= t for r in rules)
        assert got[k] == ("block" if n else "allow", n)
    assert got[3][0] == "block" and got[4] == ("allow", 0) and got[5][0] == "block"


def test_one_template_is_one_itemset_and_few_urls_are_none(spark):
    path = "/".join(f"t{chr(97 + k)}" for k in range(18))
    template = lambda n: spark.createDataFrame([(f"http://h.org/{path}/{i}x", True) for i in range(n)] + [(f"http://other{i}.org/{i}", False) for i in range(200)], "url string, bad boolean")
    sets = urlfilter.token_sets(template(40))
    assert urlfilter.itemsets(sets, 20).count() < 100
    assert urlfilter.mine_rules(template(10)).count() == 0
    rules = urlfilter.mine_rules(template(40)).collect()
    assert len(rules) == 1 and rules[0].n_tokens > 18 and rules[0].confidence == 1.0


def test_labels_come_by_id(spark):
    pages = spark.createDataFrame([(1, "a://b"), (2, "a://c"), (2, "a://d"), (3, None), (None, "a://e"), (4, "a://f"), (5, "a://g")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (None, 0), (5, None), (9, 0), (2, 0)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in urlfilter.labelled_urls(pages, labels).collect())
    assert got == [("a://b", True), ("a://c", False), ("a://c", True), ("a://d", False), ("a://d", True)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labelled = spark.createDataFrame([], "url string, bad boolean")
    assert urlfilter.filter_urls(pages, labelled).count() == 0


def test_no_rule_of_the_tables_stands_on_few_urls(spark):
    from opinara.llm import queries

    sf_dir = "/root/testdata/sf0.1"
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    rules = urlfilter.mine_rules(urlfilter.labelled_urls(pages, labels)).collect()
    n = urlfilter.token_sets(urlfilter.labelled_urls(pages, labels)).count()
    assert all(r.support * n >= 19.5 for r in rules)
    out = queries.op8_url_rules(spark, sf_dir)
    assert out.count() == pages.count()
    assert rules or out.where("rule is null and verdict = 'block'").count() == 0


def test_the_method_decides_pages_where_urls_carry_a_signal(spark):
    """The pages of sf0.1 with a planted combination of tokens: neither token alone is bad, both together are."""
    import zlib

    urls = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()]
    h = lambda k, n: zlib.crc32(f"{k}:{n}".encode()) / 2**32

    def planted(k, url):
        base, sep, query = url.partition("?")
        one, two = h(k, "path") < 0.4, h(k, "query") < 0.4
        return (base.rstrip("/") + ("/promo" if one else "") + sep + query + (("&" if sep else "?") + "campaign=x" if two else "")).replace("#top", ""), one and two

    pages = [(k, *planted(k, u)) for k, u in urls if u]
    labelled = [(u, h(k, "bad") < (0.95 if both else 0.1)) for k, u, both in pages if k % 5 < 2]
    out = urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, planted boolean").select("page_id", "url"), spark.createDataFrame(labelled, "url string, bad boolean"), rules=())
    got = {r.page_id: r.verdict == "block" for r in out.collect()}
    rest = [(got[k], both) for k, _, both in pages if k % 5 >= 2]
    hit, false = (sum(g for g, b in rest if b == side) / sum(b == side for _, b in rest) for side in (True, False))
    assert len(rest) > 1000 and hit > 0.95 and false < 0.05
