"""Decontamination, the n-gram join, token counts and page extraction."""
import html
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from surveykit.llm import decontam, html_extract, ngram_join, token_counts
from surveykit.llm.queries import op6_html_extraction

WORDS = [a + b for a in ("th", "er", "on", "ble", "wh", "ing") for b in ("an", "in", "ou", "ea", "st", "re", "ti")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edits(item, text):
    """Least edit distance of the item to a passage of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_contamination_equals_brute_force(docs_of, spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(8, 25))) for i in range(8)] + [(8, "tiny"), (9, None), (10, ""), (11, "short piece here")]
    items.append((12, items[0][1]))
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 40))
        if i % 3 == 0:
            t = list(rng.choice(items[:8])[1])
            for _ in range(rng.randint(0, len(t) // 6)):
                k = rng.randrange(len(t))
                t[k:k + 1] = rng.choice([[], ["x"], [t[k], "q"]])
            text = text + "  " + "".join(t).upper().replace(" ", "\n") + " " + prose(rng, 10)
        rows.append((i, text))
    rows += [(90, None), (91, ""), (92, "a tiny one"), (93, "not tinyx"), (94, "Short  PIECE here"), (None, items[1][1]), (95, items[2][1] * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs_of(rows), bench).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        data = decontam.normal_bytes(text)
        want = []
        for k, item in items:
            p = decontam.normal_bytes(item)
            if len(p) >= decontam.Q:
                most = int(len(p) * decontam.EDITS)
                if (p in data) or (len(data) < 2000 and data and edits(p, data) <= most):
                    want.append(k)
            elif p and f" {p.decode()} " in f" {data.decode()} ":
                want.append(k)
        assert got[i].item_ids == want and got[i].contaminated == bool(want), (i, want, got[i])
    assert decontam.contamination(docs_of([]), bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs_of(rows), bench.limit(0)).collect())


def last_row(item, data):
    """Least edits of the item to a passage that ends at each byte."""
    row = [0] * (len(data) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(data, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


@pytest.mark.parametrize("window, repeats", [(1 << 18, 8), (60, 8), (60, 0), (1 << 18, 0)])
def test_short_items_and_runs_equal_the_full_table(monkeypatch, window, repeats):
    monkeypatch.setattr(decontam, "WINDOW", window)
    monkeypatch.setattr(decontam, "REPEATS", repeats)
    monkeypatch.setattr(decontam, "HITS", 50)
    rng = random.Random(window + repeats)
    items = [(m, "".join(rng.choice("abc") for _ in range(m))) for m in range(8, 41)] + [(50, "a" * 12), (51, "ab" * 10), (52, "name ____________________ date"), (53, "-" * 35)]
    index = decontam.BenchmarkIndex(items)
    for t in range(60):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(200)))
        for _ in range(rng.randrange(3)):
            w = list(rng.choice(items)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], ["x"], [w[at], "y"]])
            text += "".join(w) + rng.choice(["", "b", " c "])
        text += rng.choice(["", "_" * 150, "a" * 200, "-" * 90 + "x" + "-" * 90])
        data = decontam.normal_bytes(text)
        want = []
        for i, item in items:
            p = decontam.normal_bytes(item)
            k = int(len(p) * decontam.EDITS)
            row = last_row(p, data)
            ends = [e for e, x in enumerate(row) if x <= k]
            groups = []
            for e in ends:
                if groups and e - groups[-1][-1] <= max(1, k):
                    groups[-1].append(e)
                else:
                    groups.append([e])
            want += [(i, min(g, key=lambda e: (row[e], e)), min(row[e] for e in g)) for g in groups]
        assert sorted(index.search(text)) == sorted(want), (t, text)


def test_long_runs_and_many_quotes_end_soon():
    import time
    index = decontam.BenchmarkIndex([(1, "fill in ________________________ here please"), (2, "z" * 300), (3, "the quick brown fox jumps over the lazy dog again")])
    began = time.time()
    assert index.search("_" * 1_000_000) == []
    assert {p[0] for p in index.search("z" * 1_000_000)} == {2}
    assert len(index.search("the quick brown fox jumps over the lazy dog again, and " * 20_000)) == 20_000
    assert time.time() - began < 60


def test_blocks_of_the_benchmark(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    items = [(f"item {i}", prose(rng, 12)) for i in range(9)]
    rows = [(i, prose(rng, 5) + " " + items[i % 9][1] + " end") for i in range(20)] + [(30, None), (31, "clean")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, decontam.contamination(docs_of(rows), bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    assert sorted(map(str, decontam.contamination(docs_of(rows), bench).collect())) == whole
    assert all(f"item {i % 9}" in r for i, r in zip(range(20), sorted(whole, key=lambda r: int(r.split("=")[1].split(",")[0]))))


def near_rows(rng):
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(40)]
    n = 100
    for base in range(6):
        words = prose(rng, rng.randint(20, 120)).split()
        for _ in range(14):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randint(0, 6)]
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (505, "one two"), (506, rows[45][1]),
             (None, rows[45][1]), (None, "alone here at last"), (507, "w " * 3000)]
    return rows


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return sets, [find(x) for x in range(len(rows))]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs_of, width, percent):
    rows = near_rows(random.Random(width))
    sets, comp = brute_components(rows, width, percent)
    members = defaultdict(list)
    for i, c in enumerate(comp):
        members[c].append(rows[i][0])
    want = sorted((str(rows[i][0]), len(s), str(min((m for m in members[c] if m is not None), default=None)))
                  for i, (s, c) in enumerate(zip(sets, comp)))
    got = ngram_join.component_ids(docs_of(rows), width=width, percent=percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == want
    kept = ngram_join.one_of_each(docs_of(rows), width=width, percent=percent)
    assert kept.columns == docs_of(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    best = [min((m for m in ms if m is not None), default=None) for c, ms in members.items() if sets[c]]
    assert sorted(map(str, ids)) == sorted(map(str, best + [r[0] for r, s in zip(rows, sets) if not s]))


def brute_links(sets, percent):
    return [sum(1 for j, t in enumerate(sets) if j != i and s and t and 100 * len(s & t) >= percent * len(s | t))
            for i, s in enumerate(sets)]


def test_ngram_join_counts_every_link(docs_of, monkeypatch):
    """One large group of near copies (and some copies) in several blocks: most links lie inside a component."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1 << 16)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = near_rows(random.Random(3))
    for i in range(150):
        words = list(base) + [f"z{j}" for j in range(rng.randrange(8))]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10 ** 6)}"
        rows.append((10 ** 6 + i, " ".join(words)))
    rows += [(2 * 10 ** 6 + i, rows[-1 - i % 2][1]) for i in range(5)]
    sets, _ = brute_components(rows, 3, 90)
    links = brute_links(sets, 90)
    got = ngram_join.component_ids(docs_of(rows), width=3, percent=90).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(i), k) for (i, _), k in zip(rows, links))
    assert max(links) > 80  # more than all lag rounds try


def test_ngram_join_of_an_empty_table(docs_of):
    assert ngram_join.component_ids(docs_of([])).count() == 0
    assert ngram_join.one_of_each(docs_of([])).count() == 0


def test_overlap_bound_is_a_bound():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        pool = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
        a, b = np.unique(pool[:rng.randint(1, 200)]), np.unique(pool[rng.randint(0, 150):rng.randint(160, 300)])
        bound = ngram_join.overlap_bound(ngram_join.bitmap(a), len(a), ngram_join.bitmap(b), len(b))
        assert len(np.intersect1d(a, b)) <= bound


def test_token_counts(docs_of, spark, tmp_path):
    import numpy as np
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 30))) for i in range(50)] + [(60, None), (61, ""), (None, "x y"), (62, "<|endoftext|> ß 語"), (62, "again")]
    rows.append((63, prose(rng, 3000)))
    encode = token_counts.encoder(token_counts.TOKENIZER).encode_ordinary
    want = sorted((str(i), len(encode(t or ""))) for i, t in rows)
    for block in (1, 7, 1 << 16):
        got = token_counts.count_tokens(docs_of(rows).repartition(3), block_tokens=block).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want and all(r.closed for r in got)
    assert token_counts.count_tokens(docs_of([])).count() == 0
    # real flat files, cut anywhere; the last one isn't closed
    files = {"a": [3, 5, token_counts.END_ID, token_counts.END_ID, 9], "b": [1] * 20 + [token_counts.END_ID], "c": []}
    folder = tmp_path / "token files"
    folder.mkdir()
    for name, tokens in files.items():
        (folder / name).write_bytes(np.array(tokens, dtype="<u2").tobytes())
    for block, whole in ((1, 1 << 30), (2, 0), (4, 1 << 30), (4, 0), (4, 20), (64, 0)):  # read whole, by ranges, either
        scanned = token_counts.scan_blocks(token_counts.read_token_files(spark, str(folder), block, whole))
        got = sorted((r.stream[-1], r.ordinal, r.first, r.n_tokens, r.closed) for r in token_counts.document_counts(scanned).collect())
        assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, False), ("b", 0, 0, 20, True)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please agree.</p></div><!-- ad -->
<div class="layout"><main><h1>Title &amp; more</h1><p>First <b>para</b>graph &lt;with&gt; some
words, it goes on and on.<br>Second line.<p>Next one, <a href="/x">with a link</a>, is unclosed and is long enough to count.
<div class="advert">Buy now, cheap watches!</div><p>Last paragraph of the text, which says a few more things.</p></main>
<aside><p>Other stories you may like to read today.</p></aside></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this text a lot, thank you.</p></div></section>
<form><label>Mail</label><input name=q><p>Subscribe to our letter</p></form><footer>&copy; 2020 Somebody</footer></body></html>"""


def test_page_extraction(spark):
    rng = random.Random(2)
    plain = lambda i: (f"<html><body><nav><a href=/>{prose(rng, 2)}</a></nav><div class=ad>{prose(rng, 8)}</div><article><h1>{prose(rng, 6)}</h1>"
                       + "".join(f"<p>{prose(rng, 30)}.</p>" for _ in range(4)) + f"</article><footer>{prose(rng, 4)}</footer></body></html>")
    pages = [(i, f"http://x/{i}", plain(i)) for i in range(60)] + [(100, None, PAGE), (101, "u", None), (102, "u", ""), (102, "u", ""), (None, "u", "<p"),
             (103, "u", "just text &amp; no tags"), (104, "u", "<article><p>cut &am"), (105, "u", "<article>" + "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as text", "'z' as id", "'q' as page")
    trees = html_extract.train(df)
    got = html_extract.extract(df, trees).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    for i, _, page in pages[:60]:
        parts = re.findall(r"<(?:h1|p)>(.*?)</", page)
        assert by_id[i] == "\n".join(map(html.unescape, parts))
    assert by_id[100].split("\n") == [
        "Title & more", "First paragraph <with> some words, it goes on and on. Second line.",
        "Next one, with a link, is unclosed and is long enough to count.",
        "Last paragraph of the text, which says a few more things."]
    assert by_id[101] == by_id[102] == by_id[None] == "" and by_id[104] == "cut &am"
    assert html_extract.extract(df.limit(0), None).count() == 0
    assert html_extract.train(df.where("page_id in (101, 102)")) is None


def test_decoding_never_contradicts_itself():
    import numpy as np
    nodes = html_extract.parse(PAGE)
    number = {id(v): i for i, v in enumerate(nodes)}
    rng = np.random.default_rng(0)
    for _ in range(20):
        odds = rng.normal(size=len(nodes)) * 3
        kept = html_extract.decode(nodes, odds)
        for i, v in enumerate(nodes[1:], 1):
            assert not kept[i] or kept[number[id(v.parent)]]


def test_query_on_the_given_pages(spark):
    got = op6_html_extraction(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in got:
        inside = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", inside)).split())
        assert " ".join(r.text.split()) == want


def test_frequency_sketch_takes_the_driver_no_object_a_counter(docs_of):
    texts = [" ".join(f"{i}x{k}" for k in range(1000)) for i in range(200)]
    want = np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.int64)
    for t in texts:
        np.add.at(want, (ngram_join.ngram_set(t, 3) >> np.uint64(64 - ngram_join.SKETCH_BITS)).astype(np.int64), 1)
    df = docs_of([*enumerate(texts), (None, None), (-1, "")], extra=False)
    tracemalloc.start()
    try:
        got = ngram_join.frequency_sketch(df, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == want).all() and peak < 8e6, peak
    assert ngram_join.frequency_sketch(df.where("false"), 3).sum() == 0
