"""Sharding, exact deduplication and URL rules against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

from surveykit.llm import exact_dedup, sharding, url_filter
from surveykit.llm.queries import URL_RULES

ROWS = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, "x" * 300 + "y"), (7, "x" * 300 + "z"), (8, "a b"),
        (None, "a b"), (None, None), (9, " "), (9, " "), (3, "a\tb"), (10, " a"), (11, "long " * 50_000)]


def test_lookup_table_is_filled_evenly_and_moves_little():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names)
    share = Counter(table)
    assert len(table) == sharding.next_prime(700) and max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(names[:-1], slots=len(table))
    moved = sum(a != b for a, b in zip(table, less) if a != 6)
    assert len(less) == len(table) and moved < 0.2 * len(table)


def test_assign_shards(docs_of, spark, tmp_path):
    from pyspark.sql import functions as F
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names)
    df = docs_of(ROWS)
    out = sharding.assign_shards(df, names, "doc_id", F.col("text"))
    assert set(out.columns) == set(df.columns) and out.count() == len(ROWS)
    for r in out.collect():
        key = str(r.doc_id) if r.doc_id is not None else "~" + hashlib.md5((r.text or "").encode()).hexdigest()
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % len(table)
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.assign_shards(docs_of([]), names, "doc_id").count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_exact_groups(docs_of):
    got = exact_dedup.exact_groups(docs_of(ROWS)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    assert len(got) == len(ROWS)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not seen
            seen = seen or kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert exact_dedup.exact_groups(docs_of([])).count() == 0


def test_drop_copies(docs_of):
    rows = [r for r in ROWS if r[0] is not None]
    out = exact_dedup.drop_copies(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in out) == [1, 4, 6, 7, 9, 10, 11]


def test_url_rules(spark):
    urls = ["http://a.example.org/en/126?x#y", "http://EXAMPLE.org/es/1", "https://example.org/es", "http://org", "http://org/",
            "http://x.com/fr/9", "http://com/de/", "http://xcom/de/", "http://a.com/de", "ftp://b.COM/DE/", None, "", "no-scheme/x",
            "http://u@h.com:80/fr/", "http://a.com/fr/://b", "http://example.org/en/1/../2", "http://a.com?/fr/", "http://a.com#/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'z' as host", "'z' as rule")
    got = {r.page_id: r for r in url_filter.judge_urls(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(r), r, v) for v, r in URL_RULES
                for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_block_beats_allow_of_the_same_text_and_longer_wins():
    trie = url_filter.RuleTrie([("allow", "a.com/x"), ("block", "a.com/x"), ("allow", "a.com/x/y"), ("block", "com")])
    assert trie.match("a.com", "/x1") == ("a.com/x", "block")
    assert trie.match("b.a.com", "/x/y") == ("a.com/x/y", "allow")
    assert trie.match("b.com", "") == ("com", "block") and trie.match("b.net", "/") is None


def test_shards_replace_columns_of_their_names_in_any_case(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", 9), (1, "a", "x", 9), (None, None, "y", 8)], "doc_id long, text string, Shard string, SLOT int")
    out = sharding.assign_shards(df, ["p", "q"], "doc_id")
    assert out.columns == ["doc_id", "text", "slot", "shard"] and sharding.assign_shards(df.limit(0), ["p", "q"], "doc_id").count() == 0
    out.write.parquet(str(tmp_path / "out"))
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()} <= {"p", "q"} and out.count() == 3
