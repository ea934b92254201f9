"""The source audit against exact brute force, at any shard size."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from surveykit.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(dict.fromkeys(terms, 1))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q = share(total)
        p = {s: share(counts[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "Bb", "cC", "É", "é", "straße", "日本", "x" * 300, "\u0080", "🙂", "zz", "dd", "ee", "ff", "gg"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice(["", "1z", "\x00q", "-"]),
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "É"])) for _ in range(n)]
    return rows + [(None, "en", "s9"), ("", "xx", "s1"), ("only once", "xx", "s2"), (None, None, None), ("word " * 30_000, "en", "s1"),
                   ("same same", "yy", "a"), ("same same", "yy", "a"), ("same same", "yy", "a"), ("same", "yy", "b"), ("12 34", "zz", None)]


@pytest.mark.parametrize("seed, shard_rows, held", [(1, 1 << 17, 1 << 20), (2, 7, 1 << 20), (3, 20, 30)])
def test_against_brute_force(spark, monkeypatch, seed, shard_rows, held):
    rows = made(seed)
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr(
        "*", "'x' as term", "1 as n", "2 as docs", "'y' as item", "3 as shard", "4 as `a.b`").repartition(5)
    if held == 30:
        cut = lambda *a: list(divergence.pair_sums(*a))
        rng = np.random.default_rng(seed)
        seen = np.unique(rng.integers(0, 40 * 6, 90))
        args = (seen // 6, seen % 6, rng.integers(1, 1000, len(seen)), rng.integers(1, 50, 6))
        whole = cut(*args)
        monkeypatch.setattr(divergence, "HELD", held)
        parts = cut(*args)
        assert len(parts) > len(whole) == 1 and (np.concatenate([s for _, s in parts]) == whole[0][1]).all()
        monkeypatch.undo()
    got = divergence.source_divergence(df, shard_rows=shard_rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_partial_counts_merge_slices(monkeypatch):
    import pyarrow as pa
    rows = made(4)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    monkeypatch.setattr(divergence, "MERGED_ROWS", 20)
    batch = pa.record_batch({"lang": pa.array([x[1] or "" for x in rows]), "source": pa.array([x[2] or "" for x in rows]),
                             "text": pa.array([x[0] or "" for x in rows])})
    out = [r for b in divergence._partial(iter([batch, batch.slice(0, 40)])) for r in b.to_pylist()]
    want, docs = Counter(), Counter()
    for text, lang, source in rows + rows[:40]:
        for t, n in Counter(TERM.findall((text or "").translate(LOWER))).items():
            want[lang or "", source or "", t] += n
            docs[lang or "", source or "", t] += 1
    n, d = Counter(), Counter()
    for r in out:
        if r["term"] is not None:
            n[r["lang"], r["source"], r["term"]] += r["n"]
            d[r["lang"], r["source"], r["term"]] += r["docs"]
    assert n == want and d == docs
    assert {(r["lang"], r["source"]) for r in out if r["term"] is None} == {(x[1] or "", x[2] or "") for x in rows}


def test_large_counts_stay_exact():
    count, total, size = np.array([10**12, 0]), np.array([10**15, 7]), np.array([10**6, 3])
    assert divergence._share(count, total, size).tolist() == [1 + 10**9 * (10**12 + 1) // (10**15 + 10**6), 1 + 10**9 // 10]


def test_top_terms_and_empty(spark):
    rows = [(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} " * (i % 7 + 1), "en", f"s{i % 2}") for i in range(100)] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.source_divergence(df, top_terms=5, shard_rows=10)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, top=5)
    assert divergence.source_divergence(df.limit(0)).count() == 0
