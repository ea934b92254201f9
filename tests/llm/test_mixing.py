"""Source mixing against an iterative water filling and the quotas' own arithmetic."""
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from surveykit.llm import mixing


def rows():
    out = [(i, "w " * (i % 37 + 1), f"s{i % 5}") for i in range(400)]
    out += [(i, "w " * 3, "hot") for i in range(400, 700)]
    out += [(700, None, "s1"), (701, "", "s1"), (702, " ", None), (703, "one two", None), (703, "one two", None),
            (None, "a b c", "s2"), (704, "", "empty"), (705, "x " * 5000, "long")]
    return out


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), total * sum(sizes.values())
    while open_:
        unit = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > cap * sizes[s] + 1e-9}
        for s in full or open_:
            target[s] = cap * sizes[s] if full else unit * w[s]
        if not full:
            break
        open_ -= full
        rest -= sum(cap * sizes[s] for s in full)
    return target


@pytest.fixture(scope="module")
def mix(docs_of):
    documents, pieces = mixing.mix_sources(docs_of(rows()), shards=8)
    return documents.collect(), pieces.collect()


def test_targets_and_taken(mix, docs_of):
    documents, pieces = mix
    assert len(documents) == len(rows())
    sizes, taken = Counter(), Counter()
    for r in documents:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for r in documents:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, sizes[s] / mixing.BLOCKS + 1), s
    assert sorted(r.size for r in documents if r.source is None) == [0, 2, 2]
    again = mixing.mix_sources(docs_of(rows()).repartition(13), shards=8)[0].collect()
    key = lambda rs: sorted((str(r.id), r.place, r.size, r.taken) for r in rs)
    assert key(again) == key(documents)


def test_pieces_are_disjoint_and_spread(mix):
    documents, pieces = mix
    by_pass = defaultdict(list)
    for p in pieces:
        by_pass[p.idx, p["pass"], p.first].append((p.word, p.word + p.words))
        assert 0 <= p.shard < 8
    for spans in by_pass.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    words = Counter()
    for p in pieces:
        words[p.shard] += p.words
    assert sum(words.values()) == sum(r.taken for r in documents)
    assert max(words.values()) < 1.5 * min(words.values())


def test_splitting_tree_keeps_quotas_and_is_hypergeometric(spark):
    q = spark.createDataFrame([(0, 4000), (1, 1000), (2, 0), (3, 7)], "idx long, quota long")
    total = Counter()
    firsts = []
    for seed in range(6):
        leaves = mixing.split_quotas(q, 4, seed).collect()
        got = Counter()
        for r in leaves:
            got[r.idx] += r.quota
            assert r.quota >= 0
        assert got == {0: 4000, 1: 1000, 2: 0, 3: 7}
        for s in range(4):
            assert abs(sum(r.quota for r in leaves if r.shard == s) - 5007 / 4) <= 1
        firsts += [r.quota for r in leaves if r.idx == 1]
        total.update(got)
    mean = sum(firsts) / len(firsts)
    sd = (sum((x - 250) ** 2 for x in firsts) / len(firsts)) ** 0.5
    assert abs(mean - 250) < 1e-9 and 4 < sd < 30  # sd of the draw: 12.3


def test_mixed_documents_and_empty(docs_of):
    df = docs_of(rows())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    sizes, got, longest = Counter(), Counter(), Counter()
    for i, t, s in rows():
        n = len((t or "").split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
    for r in out.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("n")).collect():
        got[r.source] += r.n
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= longest[s] + 1, s
    assert mixing.mixed_documents(docs_of([])).count() == 0
    documents, pieces = mixing.mix_sources(docs_of([]))
    assert documents.count() == 0 and pieces.count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, shards=3)


def test_mixed_documents_lie_as_drawn(docs_of):
    """Every copy stands in its drawn shard, in the order of the local shuffle."""
    df = docs_of([(i, "w " * (i % 23 + 1) + str(i), f"s{i % 3}") for i in range(300)])

    def layout(**how):
        out = mixing.mixed_documents(df, **how).withColumn("part", F.spark_partition_id()).collect()
        parts = defaultdict(list)
        for r in out:
            parts[r.part].append(r.doc_id)
        return parts

    _, pieces = mixing.mix_sources(df, shards=4, seed=3)
    starts = {}
    for r in pieces.collect():
        at = (r.id, r["pass"])
        starts[at] = min(starts.get(at, (math.inf,)), (r.first, r.word, r.shard, r.rank))
    found = layout(shards=4, seed=3)
    copies = Counter(i for ids in found.values() for i in ids)
    passes = defaultdict(list)
    for (i, p), start in sorted(starts.items()):
        passes[i].append(start[2:])
    homes = {}
    for i, n in copies.items():
        assert n <= len(passes[i])
        for shard, rank in passes[i][:n]:
            homes[shard, rank] = i
    assert len(homes) == sum(copies.values())
    for ids in found.values():
        mine = sorted(at for at, i in homes.items() if i in ids)
        order = [homes[at] for at in mine]
        rest = iter(order)
        assert all(i in rest for i in ids)  # a partition's rows follow shard and rank
    flat = lambda parts: [parts[k] for k in sorted(parts)]
    assert flat(layout(shards=4, seed=3)) == flat(found)
    assert flat(layout(shards=8, seed=3)) != flat(found)
    assert flat(layout(shards=4, seed=4)) != flat(found)
