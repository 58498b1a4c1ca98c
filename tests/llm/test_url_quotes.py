"""URL rules and quotation links on small fixtures."""

import random

import oracle
import pytest

from weftline.llm import queries as q
from weftline.llm import quotes, urlfilter

URLS = [
    "https://www.Example.com/en/1?x=2", "http://a.example.com/en/", "http://example.com/en", "http://example.com", "com://", "no scheme", None, "",
    "http://x.net/es/1", "http://x.net/fr/", "http://net/fr/z#q", "http://x.org/a", "http://wwwexample.com/en/", "http://b.WWW.example.com/en/x", "http://ads3.example.com/fr/1",
    "http://example.com/en/1", "http://example.com:80/en/1", "x://com/?a://b", "http://é.com/ü", "http://casino.x.org/", "http://example.com/en/1",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    tail = rest[at:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["row"]["page_id"]: r for r in urlfilter.judge(pages, q.URL_RULES).collect()}
    for k, url in enumerate(URLS):
        host, path, best = brute(url)
        want = (host, path, best and best.name, best.verdict if best else "allow")
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == want
    assert urlfilter.judge(pages.limit(0), q.URL_RULES).count() == 0


def test_patterns_decide_only_where_no_host_rule_fits(spark, tmp_path):
    more = ["https://m.casino-win.example.com/de/1910?a=1", "http://ads3.x.com/a", "http://track.x.com/", "http://ads.example.com/en/7", "http://ads.x.org/", "http://betting.x.net/es/1", "http://xxx.net/de/"]
    rows = list(enumerate(URLS + more))
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    (part,) = (tmp_path / "pages.parquet").glob("*.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{part}')")
    assert oracle.differences(spark, con, q.QUERIES["op3_url_filter"], q.ORACLES["op3_url_filter"], str(tmp_path)) == ""
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in q.op3_url_filter(spark, str(tmp_path)).collect()}
    for k, url in rows:
        best = brute(url)[2]
        assert best is None or got[k] == (best.name, best.verdict)
    assert [got[len(URLS) + k] for k in range(7)] == [("com/", "allow")] * 3 + [("example.com/en/", "block"), (None, "block"), ("net/es/", "block"), (None, "block")]


def test_only_fetched_rules_run(spark):
    rules = [urlfilter.Rule("block", f"host{k}.com", "/") for k in range(300)] + [urlfilter.Rule("block", pattern="tracker")]
    pages = spark.createDataFrame([(k, f"http://host{k}.com/a") for k in range(300)] + [(300, "http://x.com/tracker")], "page_id long, url string")
    rows = urlfilter.judge(pages, rules).collect()
    assert {r["verdict"] for r in rows} == {"block"} and max(r["n_candidates"] for r in rows) == 2
    with pytest.raises(ValueError):
        urlfilter.judge(pages, rules, limit_bytes=10)


TALK = [
    (1, 0, "user", "First question here.\nIt has two lines."),
    (1, 1, "bot", "An answer to it."),
    (1, 2, "user", "On Monday the bot wrote:\n> An answer to it.\n\nThanks for that."),
    (1, 3, "bot", ">> An  ANSWER to it\n> Thanks for that.\nYou are welcome."),
    (1, 4, "user", "> It has two lines.\nBack to the start."),
    (1, 5, "bot", "> nobody ever said this\nOdd."),
    (1, 6, "user", "> Back to the start.\nAgreed."),
    (2, 0, "user", "An answer to it."),
    (2, 1, "bot", "> You are welcome.\nFrom elsewhere."),
    (2, 2, "bot", None),
    (2, 3, "bot", ""),
    (None, 4, "bot", "> x\ny"),
    (3, None, "bot", "> x\ny"),
    (2, 3, "bot", ""),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in TALK], "conv_id long, turn int, role string, text string, own string, mid int")
    got = quotes.link(df).collect()
    assert len(got) == len(TALK)
    by = {(r["row"]["conv_id"], r["row"]["turn"]): r for r in got}
    parents = {k: r["parent_turn"] for k, r in by.items() if r["parent_turn"] is not None}
    assert parents == {(1, 2): 1, (1, 3): 2, (1, 4): 0, (1, 6): 4}
    assert by[1, 2]["own"] == "\nThanks for that." and by[1, 3]["own"] == "You are welcome." and by[1, 5]["own"] == "Odd."
    assert by[1, 3]["n_passages"] == 2 and by[1, 3]["n_linked"] == 2 and by[1, 5]["n_linked"] == 0
    order = [r["row"]["turn"] for r in sorted((r for r in got if r["row"]["conv_id"] == 1), key=lambda r: r["order_key"])]
    assert by[1, 3]["order_key"] == [1, 2, 3] and by[1, 6]["order_key"] == [0, 4, 6]
    assert order == [0, 4, 6, 1, 2, 3, 5]
    assert by[3, None]["order_key"] == [None]
    assert quotes.link(df.limit(0)).count() == 0


def test_lines_and_sentences_of_longer_messages(spark):
    talk = [
        (1, 0, "Hello all\nthe build is red\nthe second node is down\nsee you"),
        (1, 1, "Hello all\nI looked at it. The disk was full, nothing else! It works again. Bye"),
        (1, 2, "> the build is red\n> the second node is down\nSince when?"),
        (1, 3, "> The disk was full, nothing else!\nWhich one?"),
        (1, 4, "> Hello all\n> It works again.\nGood."),
        (1, 5, "One sentence that is\nbroken over two lines. And more"),
        (1, 6, "> One sentence that\n> is broken over two lines.\nSo it is."),
        (1, 7, "> the build was never red\n> nor was this said\nHm."),
    ]
    got = quotes.link(spark.createDataFrame(talk, "conv_id long, turn int, text string")).collect()
    by = {r["row"]["turn"]: (r["parent_turn"], r["n_linked"]) for r in got}
    assert by == {0: (None, 0), 1: (None, 0), 2: (0, 1), 3: (1, 1), 4: (1, 1), 5: (None, 0), 6: (5, 1), 7: (None, 0)}
    assert {r["row"]["turn"]: r["order_key"] for r in got}[4] == [1, 4]


def test_deep_threads(spark):
    rng = random.Random(1)
    rows, parent = [(9, 0, "user", "message number 0")], {}
    for k in range(1, 40):
        parent[k] = rng.randrange(max(0, k - 3), k)
        rows.append((9, k, "user", f"> message number {parent[k]}\nmessage number {k}"))
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()

    def path(k):
        return [k] if k == 0 else path(parent[k]) + [k]

    assert all(r["order_key"] == path(r["row"]["turn"]) for r in got)
