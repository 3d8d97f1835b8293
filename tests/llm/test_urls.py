from pyspark.sql import functions as F

from kelpline.llm import urls
from kelpline.llm.queries import ORACLE_SQL, QUERIES

PAGES = "page_id long, url string, html string, host string, path string, good int, bound double"


def judged(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "h", "p", 7, 0.0) for i, u, h in rows], PAGES)
    return {r["page_id"]: r for r in urls.judge(df, urls.plain_outcome(F.col("html")), **options).collect()}


def test_sql(agrees):
    agrees(QUERIES["op6_url_filters"], ORACLE_SQL["op6_url_filters"])


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "https://example.net": ("example.net", "", None, "allow"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "x://w.example.com/de/?q=://z": ("w.example.com", "/de/", "example.com/de/", "block"),
        "://k.org/fr/a/b#": ("k.org", "/fr/a/b", "org/fr/", "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://h?x://y/": ("h", "", None, "allow"),
        "a\nb://c.net/\nd?e": ("c.net", "/\nd", "net/", "block"),
        "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    got = judged(spark, [(k, u, "fine") for k, u in enumerate(cases)])
    for k, (u, want) in enumerate(cases.items()):
        assert tuple(got[k])[1:] == want, u


def test_reputation_blocks_bad_hosts_only(spark):
    bad, good = "### " * 9, "plain text"
    rows = [(i, f"http://bad.spam.com/{i}", bad) for i in range(40)] + [(100 + i, f"http://h{i % 8}.fine.com/{i}", good) for i in range(200)]
    rows += [(400, "http://h1.fine.com/x", bad), (401, "http://new.fine.com/", None), (402, "http://new.fine.com/", "")]
    got = judged(spark, rows)
    assert {got[i]["verdict"] for i in range(40)} == {"block"}
    assert {got[i]["verdict"] for i in (100, 150, 400, 401, 402)} == {"allow"}


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.b/", None, "h", "p", 7, 0.0)] * 3 + [(None, None, None, "h", "p", 7, 0.0)], PAGES)
    assert urls.judge(df, F.lit(None).cast("int")).count() == 4


def test_registered_domains(spark):
    want = {
        "shop.example.co.uk": ("example.co.uk", "co.uk"), "example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.github.io": ("b.github.io", "github.io"), "www.example.com": ("example.com", "com"),
        "a.com:8080": ("a.com", "com"), "me:pw@www.a.com": ("a.com", "com"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.com.": ("a.com", "com"),
        "notco.uk": ("notco.uk", "uk"), "[::1]": ("[::1]", "[::1]"),
    }
    own = spark.createDataFrame([(h,) for h in want], "host string")
    got = own.select("host", urls.domain_of(urls.F.col("host")).alias("d"), urls.suffix_of(urls.F.col("host")).alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == want


def test_sql_on_hosts_of_all_kinds(spark, tmp_path):
    import duckdb

    from kelpline.llm.queries import ORACLE_SQL, QUERIES

    hosts = ["shop.example.co.uk", "other.co.uk", "a.github.io", "b.github.io", "10.1.2.3", "10.1.2.4:80", "u@x.com:81", "x.com", "localhost", "y.x.com.", "", "net", "a.example.net"]
    rows = [(k, None if k % 41 == 0 else f"http://{hosts[k % len(hosts)]}/en/{k}", "### " * (k % 9) if k % 7 else "") for k in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ours = sorted(map(tuple, QUERIES["op6_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert ours == sorted(duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op6_url_filters']})").fetchall())
