"""Fill-in-middle against slicing by code points, and the boundary set against sorted lists."""
import hashlib
import random
import re

import numpy as np
import pytest

from surveykit.llm import fill_middle as fm

TEXTS = [None, "", "a", "abc", "é", "日本語 text", "<P>x", "a<S>b", "c<M>", "< P>", "<", "<P", "ends with <S", ">", "\x00\x00", "a\nb\n\nc", "  lead",
         "🙂" * 5, "x" * 70_000, "é" * 70_000, "aé" * 40_000, "a" * 65_535, "a" * 65_536, "a" * 65_537, "é" * 32_768, "tie", "tie"]


def reference(doc_id, text, unit=None):
    text = text or ""
    units = list(text) if unit is None else unit(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def unit_of(name):
    return {"char": None, "word": lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", t),
            "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}[name]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_against_slices(spark, unit):
    rows = [(1000 * k + i, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, "abc abc abc"), (0, "abc abc abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as N", "1 as row", "2 as Output", "3 as cut", "4 as `a.b`")
    out = fm.fill_in_middle(df, unit=unit)
    assert sorted(out.columns) == sorted(["doc_id", "text", "row", "cut", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"])
    from pyspark.sql import functions as F
    got = out.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), t or "", *reference(i, t, unit_of(unit))) for i, t in rows)
    assert want == sorted((str(r.doc_id), r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(df.limit(0), unit=unit).count() == 0


@pytest.mark.parametrize("shape", ["run", "array", "bitmap", "mixed", "gaps"])
def test_boundary_set(shape):
    rng = random.Random(shape)
    data = {"run": b"a" * 200_001, "array": ("\n" + "a" * 99).encode() * 3000, "bitmap": "aé日".encode() * 40_000,
            "mixed": b"a" * 70_000 + "é".encode() * 60_000 + b"\n" * 10, "gaps": b"a" * 300_000 + b"\nb"}[shape]
    lines = shape in ("array", "gaps")
    bounds = fm.BoundarySet(np.frombuffer(data, np.uint8), fm.UNITS["line" if lines else "char"])
    if lines:
        want = [0] + [m.end() for m in re.finditer(b"\n", data) if m.end() < len(data)] + [len(data)]
    else:
        want = [i for i, x in enumerate(data) if x & 0xC0 != 0x80] + [len(data)]
    assert len(bounds) == len(want)
    kinds = {type(c).__name__ for c in bounds.containers}
    assert {"run": "RunContainer", "array": "ArrayContainer", "bitmap": "BitmapContainer"}.get(shape, "RunContainer" if shape == "mixed" else "ArrayContainer") in kinds
    for k in [0, len(want) - 1, *(rng.randrange(len(want)) for _ in range(500))]:
        assert bounds.select(k) == want[k]
    for k in (-1, len(want)):
        with pytest.raises(IndexError):
            bounds.select(k)
