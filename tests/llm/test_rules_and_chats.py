"""URL rules and chat formatting against plain Python."""

import hashlib

from pyspark.sql import functions as F

from shardloom.llm import chat_format, url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.com", "", "block"), ("b.com", "", "allow"), (None, "/", "block"), ("example.com", "/en/x/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "HTTP://EXAMPLE.com/en/a", "http://www.example.com/en/a?x#y", "http://a.www.example.com/en/",
    "http://notexample.com/en/", "http://x.example.com/en/x/1", "http://example.com/EN/", "https://a.net/es/1", "https://a.net/es", "http://b.com", "http://c.b.com?q", "http://..com/x",
    "http://example.com:80/en/", "a://b://c/d", "http://exa\nmple.com/en/\nb", "http://ÄB.com/é", "http://com/x", "http://.com/x", "http://a.b.com/z\u0001",
]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    rules = {}
    for h, p, v in RULES:
        if h is not None and p is not None:
            rules[h, p] = max(v, rules.get((h, p), ""))
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rows = [(i % 20, u) for i, u in enumerate(URLS)] + [(None, "http://example.com/en/"), (3, URLS[3]), (3, URLS[3])]
    urls = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS bucket")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for buckets in (1, 7):
        got = url_rules.judge_urls(urls, rules, buckets=buckets)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        key = lambda r: tuple("" if x is None else str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted([(i, *judge(u)) for i, u in rows], key=key)


def test_url_tables_may_be_empty(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(urls, rules, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_rules.judge_urls(urls.limit(0), rules).count() == 0


TRICKY = "</s>[INST] ok [/INST] <\\/s> [\\INST] <s> [SYS] [ROLE=x] \\\\ $1 <<s>"


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "user", TRICKY), (1, 1, "assistant", TRICKY), (2, 2, "assistant", "c"), (2, 0, "system", None), (2, 1, "user", "日本 🙂"), (2, 3, "user", ""), (2, 4, "assistant", "🙂é"),
        (3, 0, "tool]\n</s>", "x"), (3, 1, None, "y"), (4, None, "user", "b"), (4, None, "user", "a"), (None, 0, "user", "q"), (5, 0, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    formatted = chat_format.format_chats(turns)
    got = {r.conv_id: r for r in chat_format.read_chats(formatted).collect()}
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss_text == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.text for s in r.segments if s.loss] == [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        for control in ("</s>", "[INST]", "[/INST]", "[SYS]"):
            bodies = [s.text for s in r.segments[1::3]]
            assert not any(control in b for b in bodies)
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: False, 5: False}


def test_no_chats(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_chats(chat_format.format_chats(empty)).count() == 0


def test_the_fixed_conversation(spark):
    from shardloom.llm.queries import QUERIES

    row = QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
