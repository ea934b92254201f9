"""Toxicity and context-tree weighting: held-out accuracy and a naive context tree."""
import math
import random
import tracemalloc
import zlib
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from surveykit.llm import ctw, toxicity


def test_toxicity_finds_planted_sentences(docs_of, spark):
    rng = random.Random(4)
    words = [a + b for a in ("th", "er", "on", "ble") for b in ("an", "in", "ou", "ea", "st", "re", "ti")]
    bad = ["idiotic", "scum"]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 30))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(sentences))
                sentences[k] += " " + rng.choice(bad) + rng.choice(["", "er", "al"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic if rng.random() > 0.02 else not toxic)))
    rows += [(1000, None), (1001, ""), (None, "scum"), (1002, "the end. " * 30_000), (1003, "...!"), (0, rows[0][1])]
    labels += [(1000, None), (None, 1), (5000, 1), (1, 0)]
    df = docs_of(rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_sample(df, table))
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        if r.doc_id is None:
            assert r.predicted == 1
        elif r.doc_id >= 1000:
            assert r.predicted == 0
        elif r.held_out:
            assert r.predicted == (r.doc_id % 6 == 0), r
    found = toxicity.offending_sentences(df, model).collect()
    assert found and all("scum" in r.sentence or "idiotic" in r.sentence for r in found)
    assert toxicity.fit(toxicity.training_sample(df, table.limit(0))).weights == {}
    assert toxicity.score_documents(docs_of([]), model).count() == 0
    again = toxicity.fit(toxicity.training_sample(df.repartition(7), table.repartition(3)))
    assert again.weights == model.weights and again.leak == model.leak


def test_toxicity_on_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    scored = toxicity.score_documents(docs, model).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in scored) / len(scored)
    assert hit > 0.97 and sum(r.predicted for r in scored if r.toxic == 0) <= 0.01 * len(scored)


def test_toxicity_fit_leaves_the_texts_off_the_driver(docs_of, spark):
    words = [f"w{i}x" for i in range(400)]
    rows = [(i, ". ".join(words[(i + k) % 400] for k in range(1000)) + " scum." * (i % 4 == 0)) for i in range(300)]
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs_of(rows), table).repartition(3)
    kept = [(r[1], int(r[0] % 4 == 0)) for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    del rows
    tracemalloc.start()
    try:
        model = toxicity.fit(sample)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1e6, peak  # about 1.5 million bytes of text
    assert model == toxicity.fit_rows(kept) and "scum" in model.weights
    assert toxicity.fit(sample.where("false")) == toxicity.fit_rows([])


class NaiveTree:
    """Context-tree weighting by the book, one dictionary entry per (context, bits)."""

    def __init__(self, texts, depth):
        self.depth, self.count, self.below = depth, Counter(), {}
        for data in texts:
            for ctx, node, bit in self.decisions(data):
                for d in range(depth + 1):
                    self.count[ctx[:d], node, bit] += 1
                    self.below.setdefault((ctx[:d], node), set()).add(ctx[:d + 1] if d < depth else None)
        self.cache = {}

    def decisions(self, data):
        padded = b"\n" * 7 + data
        for i in range(7, len(padded)):
            ctx, node = padded[i - self.depth:i][::-1], 1
            for k in range(7, -1, -1):
                bit = padded[i] >> k & 1
                yield ctx, node, bit
                node = node * 2 | bit

    def parts(self, ctx, node):
        """(ln KT, ln of the children's product, ln weighted) of a context node."""
        if (ctx, node) not in self.cache:
            a, b = self.count[ctx, node, 0], self.count[ctx, node, 1]
            kt = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(ctx) == self.depth:
                self.cache[ctx, node] = kt, kt, kt
            else:
                s = sum(self.parts(c, node)[2] for c in self.below.get((ctx, node), ()))
                self.cache[ctx, node] = kt, s, np.logaddexp(kt, s) - math.log(2)
        return self.cache[ctx, node]

    def predict(self, ctx, node, bit, d=0):
        a, b = (self.count[ctx[:d], node, k] for k in (0, 1))
        kt = ((a, b)[bit] + .5) / (a + b + 1)
        if d == self.depth or not any(self.count[ctx[:d + 1], node, k] for k in (0, 1)):
            return kt
        own, s, _ = self.parts(ctx[:d], node)
        w = 1 / (1 + math.exp(min(700, s - own)))
        return w * kt + (1 - w) * self.predict(ctx, node, bit, d + 1)

    def score(self, data):
        return sum(math.log10(self.predict(*x)) for x in self.decisions(data))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["the", "there", "on", "ßeta", "Once", "in", "inner", "x"]
    rows = [(i, "  ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (None, "the on"), (72, " \n"), (73, rows[5][1]), (73, rows[5][1]), (74, "unseen zzz")]


def test_context_tree_scores(docs_of, corpus):
    df = docs_of(corpus).repartition(4)
    got = sorted(ctw.score_texts(df, parts=5).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    norm = lambda t: b" ".join((t or "").encode().lower().split())
    train = [norm(t) for i, t in corpus if not held(i)]
    tree = NaiveTree([t + b"\n" for t in train], ctw.DEPTH)
    count = Counter(w for t in train for w in t.split())
    ends = len(train)
    n, v = sum(count.values()) + ends, len(count) + 1
    assert any(map(held, [i for i, _ in corpus])) and len(got) == len(corpus)
    want = []
    for i, t in corpus:
        ws = norm(t).split()
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        want.append((i, held(i), len(ws) + 1, sum(w in count for w in ws) + 1, n, base, tree.score(norm(t) + b"\n")))
    for r, w in zip(got, sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))):
        assert tuple(r)[:5] == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-5)


def test_probabilities_sum_to_one():
    texts = [b"the thing", b"then", b"other"]
    tree = NaiveTree([t + b"\n" for t in texts], 3)
    total = sum(10 ** sum(math.log10(tree.predict(ctx, node, bit)) for ctx, node, bit in
                          list(tree.decisions(b"th" + bytes([x])))[-8:]) for x in range(256))
    assert math.isclose(total, 1)


def test_empty_table_and_no_training_rows(docs_of, corpus):
    assert ctw.score_texts(docs_of([])).count() == 0
    only = [r for r in corpus if r[0] is not None and crc32(str(r[0]).encode()) % 7 == 2][:2]
    for r in ctw.score_texts(docs_of(only), parts=3).collect():
        size = len(b" ".join((dict(only)[r.doc_id] or "").encode().lower().split())) + 1
        assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, -8 * size * math.log10(2), rel_tol=1e-5)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (ctw.unpack(ctw.pack(keys)) == keys).all()
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    assert (ctw.Lookup([(keys, np.arange(len(keys)))])(keys) == np.arange(len(keys))).all()


def test_texts_reach_workers_in_bounded_batches(docs_of, spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "there", "on"]) + str(rng.randrange(50)) for _ in range(2000))) for i in range(500)]
    longest = max(len(t) for _, t in rows)
    most = (2 << 20) + 2 * longest
    assert sum(len(t) for _, t in rows) > 2 * most

    def bounded(real):
        def make(*args):
            inner = real(*args)

            def run(frames):
                def checked():
                    for frame in frames:
                        size = int(frame["text"].str.len().sum())
                        if size > most:
                            raise ValueError(f"a batch of {size} bytes of text")
                        yield frame
                yield from inner(checked())
            return run
        return make

    monkeypatch.setattr(ctw, "_requests", bounded(ctw._requests))
    monkeypatch.setattr(ctw, "_score", bounded(ctw._score))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert ctw.score_texts(docs_of(rows, extra=False).coalesce(1), parts=2).count() == len(rows)
    assert spark.conf.get(key) == before


def test_counting_holds_a_chunk_beside_its_grams():
    rng = random.Random(10)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(1500)]
    frame = pd.DataFrame({"text": texts, "training": True, "block": "b"})
    tracemalloc.start()
    try:
        rows = pd.concat(ctw._requests(3)(iter([frame])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90e6, peak  # 4 million bytes of text
    want = Counter()
    for codes, _ in ctw.gram_chunks([ctw.words_of(t) for t in texts]):
        want.update(codes.tolist())
    got = {}
    for r in rows[rows["kind"] == "gram"].itertuples():
        got.update(zip(ctw.unpack(r.keys).tolist(), np.frombuffer(zlib.decompress(r.counts), np.int64).tolist()))
    assert got == dict(want)
