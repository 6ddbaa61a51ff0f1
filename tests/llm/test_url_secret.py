import hashlib
import random
import re

from pyspark.sql import functions as F

from retort.llm import secret_scan, url_reputation

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_rules_and_parts(spark):
    urls = ["https://a.example.com/en/7?x", "https://EXAMPLE.net/de/8", "http://b.net/de/9", "x://org/es/", "x://myorg/es/1", "https://b.com/en", "no address", None, "a://h#x://net/de/", "://net/de/1", "http://u.example.net:80/de/8"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filtered(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[2] == ("b.net", "/de/9", "net/de/", "allow")
    assert got[3] == ("org", "/es/", "org/es/", "block")
    assert got[4] == ("myorg", "/es/1", None, "allow")
    assert got[5] == ("b.com", "/en", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("h", "", None, "allow")
    assert got[9] == ("net", "/de/1", "net/de/", "allow")
    assert got[10] == ("u.example.net:80", "/de/8", None, "allow")
    assert url_reputation.filtered(pages.limit(0), labels).count() == 0


def test_reputation_shrinks(spark):
    hosts = [("bad.one.org", 200, 190), ("few.two.org", 2, 2), ("good.two.org", 300, 3), ("new.one.org", 0, 0), ("x.three.net", 50, 1)]
    got = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert got["bad.one.org"].bound > 0.5 > got["few.two.org"].bound > 0
    assert got["good.two.org"].rate < got["few.two.org"].rate < 1
    assert got["new.one.org"].rate > got["x.three.net"].rate
    two = url_reputation.reputation(spark.createDataFrame([("a.co.uk", 1, 0)], "host string, n long, bad long"), suffixes=("co.uk",))
    assert two.count() == 1


def test_labelled_pages_decide(spark):
    pages = [(i, f"https://{'junk' if i % 2 else 'fine'}.example.org/en/{i}.html") for i in range(80)]
    labels = [(i, int(i % 2 == 0), 0) for i in range(80)] + [(0, 1, None), (None, 0, 1)]
    got = url_reputation.filtered(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.verdict for r in got.collect() if r.page_id % 2} == {"block"}
    assert {r.verdict for r in got.collect() if not r.page_id % 2} == {"allow"}


def test_many_hosts_and_a_hot_one(spark):
    hot = spark.range(60_000).selectExpr("id as page_id", "concat('http://hot.bad.org/en/', id % 40) as url")
    rest = spark.range(105_000).selectExpr("id + 100000 as page_id", "concat('http://h', id, '.example.net/en/', 1000 + id % 9) as url")
    odd = spark.createDataFrame([(None, None), (None, "x"), (1, "http://hot.bad.org/en/1"), (1, "http://hot.bad.org/en/1")], "page_id long, url string")
    pages = hot.union(rest).union(odd).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "n", "bad", "domain")})
    labels = spark.createDataFrame([(k, 0, 0) for k in range(40)] + [(1000 + k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    got = url_reputation.filtered(pages, labels)
    assert url_reputation.MAX_HOSTS < 105_000
    by = {(r.verdict, r.hot): r.n for r in got.groupBy("verdict", (F.col("host") == "hot.bad.org").alias("hot")).agg(F.count("*").alias("n")).collect()}
    assert by == {("block", True): 60_002, ("allow", False): 105_002}


def test_levels_in_parts_give_what_broadcasts_give(spark):
    many = spark.range(20_000).selectExpr("concat('h', id, '.one.org') as host", "id % 3 as n", "least(id % 3, id % 2) as bad")
    few = spark.createDataFrame([("a.two.net", 40, 30), ("org", 3, 0), ("", 1, 1), ("b.three.net", 9, 0)], "host string, n long, bad long")
    whole, dealt = (url_reputation.reputation(many.union(few), max_groups=k) for k in (100_000, 1))
    assert whole.count() == dealt.count() == 20_004
    both = whole.join(dealt.select("host", F.col("bound").alias("other")), "host")
    assert both.where("abs(bound - other) < 1e-9").count() == 20_004


def test_unnumbered_pages_of_many_hosts(spark):
    """Null numbers, numbers without label and one document on all hosts: every page is judged, and only labels count."""
    pages = spark.range(9000).selectExpr("id as page_id", "concat('http://h', id % 3000, '.site.org/', case id % 3 when 0 then 'about' when 1 then '77' else '5' end) as url")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_reputation.filtered(pages, labels)
    assert got.count() == 9000 and got.where("verdict not in ('allow', 'block')").count() == 0
    assert url_reputation.filtered(pages.limit(0), labels).count() == 0
    rates = url_reputation.filtered(pages, labels, max_hosts=1)
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, got.collect()))


def test_bound_is_near_the_quantile(spark):
    import numpy as np

    r = np.random.default_rng(1)
    for a, b in ((12.5, 37.5), (3.0, 60.0), (0.8, 5.0), (200.0, 700.0)):
        (ma, va), (mb, vb) = url_reputation._moments(F.lit(a)), url_reputation._moments(F.lit(b))
        got = spark.range(1).select((1 / (1 + F.exp(-(ma - mb - url_reputation.Z * F.sqrt(va + vb))))).alias("q")).first().q
        share = (r.beta(a, b, 200_000) < got).mean()
        assert abs(share - (1 - url_reputation.CREDIBLE)) < (0.02 if a > 1 else 0.05)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(k == x for _, k, _ in found) for x in range(3)], hashlib.sha256(listed.encode()).hexdigest(), listed


def test_base_spans_against_brute_force(spark, edge_docs, no_docs):
    r = random.Random(6)
    bits = ["token", "=", " : ", "password", "PassWd", "api_key", "APIKEY", '"', "'", "abcdefabcdef0123", "AKIA", "AKIAABCDEFGHIJKLMN", "é", "\n", " ", "0123456789abcdef0", "xyzXYZ123+/_.", "secret"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 14))) for _ in range(400)] + ["token=password: abcdefghijklmnop", None, "", "AKIA" * 9, "ab" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in secret_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        n, sha, listed = base(t)
        assert ([got[i].n_assign, got[i].n_access, got[i].n_hex], got[i].base_sha256) == (n, sha), t
        assert set(listed.split(",")) <= set(got[i].spans.split(","))
    assert secret_scan.scan(edge_docs).count() == edge_docs.count()
    assert secret_scan.scan(no_docs).count() == 0


def test_weak_parts_need_their_complements(spark):
    token, far = "aB3dEfGhIjKlMnOpQrStUv", "word " * 100
    long = token * 20
    beside = [(7, f"{long} user=bob"), (8, f"user=bob {long}")]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(beside, "doc_id long, text string")).collect()}
    assert got == {7: "token:0:440,account:441:449", 8: "account:0:8,token:9:449"}  # the order of parts doesn't matter
    rows = [(1, f"user=bob has {token} at https://x.example/a"), (2, f"{token} alone"), (3, "user=bob alone"), (4, "https://x.example/a alone"), (5, f"user=bob {far} {token}"), (6, f"{token} at https://x.example/a")]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()}
    assert got[1].spans == "account:0:8,token:13:35,endpoint:39:58" and got[1].n_linked == 3
    assert all(got[i].spans == "" for i in (2, 3, 4, 5, 6))


def test_links_against_brute_force(spark):
    import duckdb

    r = random.Random(8)
    token = lambda: "aB3" + "".join(r.choices("xyzXYZ123", k=r.choice((18, 30, 300))))
    bits = [lambda: "user=bob", token, lambda: "https://x.example/a", lambda: "AKIAABCDEFGHIJKLMN", lambda: "password: abcdefghijklmnop", lambda: "0123456789abcdef0123"]
    texts = [" ".join(r.choice(bits)() if r.random() < 0.5 else "w" * r.choice((3, 90, 200, 239, 240)) for _ in range(r.randint(1, 12))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secret_scan.scan(docs).collect()}
    patterns = dict(zip(secret_scan.KINDS, (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.ACCOUNT, secret_scan.TOKEN, secret_scan.ENDPOINT), strict=True))
    linked = 0
    for i, t in enumerate(texts):
        found = [(m.start(), k, m.end()) for k, p in enumerate(patterns.values()) for m in re.finditer(p, t or "")]
        found = [(s, k, e) for s, k, e in found if k != 4 or all(re.search(c, t[s:e]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        found = [(s, k, e) for s, k, e in found if k or len(re.fullmatch(patterns["assign"], t[s:e])[2]) >= 12]
        by = lambda s, e, kinds: any(k in kinds and s2 - e <= 240 and s - e2 <= 240 for s2, k, e2 in found)  # noqa: B023, E731
        kept = [(s, k, e) for s, k, e in found if k < 3 or (k == 4 and by(s, e, (1, 3))) or (k == 3 and by(s, e, (0, 2, 4))) or (k == 5 and by(s, e, (1, 3)) and by(s, e, (0, 2, 4)))]
        assert got[i] == ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(kept)), t
        linked += sum(k > 2 for _, k, _ in kept)
    assert linked > 100
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {x[0]: x[5] for x in con.sql(secret_scan.SQL).fetchall()} == got


def test_many_matches_take_no_square_time(spark):
    import time

    docs = spark.createDataFrame([(1, "0123456789abcdef0 " * 60_000)], "doc_id long, text string")
    start = time.time()
    row = secret_scan.scan(docs).first()
    assert row.n_hex == 60_000 and row.spans.endswith(f"hex:{18 * 59_999}:{18 * 60_000 - 1}")
    assert time.time() - start < 60
