"""Chat formatting: exact round trips, spans, and templates that rewrite history."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from surveykit.llm import chat_format as cf

ODD = ["", "a", "b", "ab", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "<\\", "\\n", "\n", "é🙂", "<|<|<\\|",
       "x" * 100_000, " lead", "trail ", "assistant", "<|im_end|><|im_start|>assistant ok"]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("<|\\ani\n") for _ in range(rng.randrange(12))) for _ in range(500)]
    assert all("<|" not in cf.escape(t) for t in texts)
    df = spark.createDataFrame([(t, cf.escape(t)) for t in texts], "t string, e string")
    assert df.where(cf.unescaped(F.col("e")) != F.col("t")).count() == 0


def chats():
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", None, "a\\nb", "odd\nrole", "\\", "<|im_end|>", "tool"])
            rows.append((c, t, role, rng.choice([*ODD, None])))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "first"), (77, 1, "user", "tie b"), (77, 1, "user", "tie a"),
             (77, 1, "user", "tie a"), (78, 0, None, None)]
    rows += [(79, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    rng.shuffle(rows)
    return rows


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_whole_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as id", "2 as n_turns", "'x' as formatted", "3 as spans", "4 as `a.b`").repartition(7)
    out = cf.format_chats(df).withColumn("turns", cf.chatml_turns()).withColumn("loss", cf.loss_text())
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows} and out.count() == len(got)
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=order)]
        assert r.n_turns == len(turns) and [tuple(t) for t in r.turns] == turns and r.rewritten == []
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted == cf.chatml(turns)
        assert [s.start for s in r.spans] == [0, *(s.end for s in r.spans)][:-1] and r.spans[-1].end == len(r.formatted)
    assert cf.format_chats(df.limit(0)).count() == 0


def test_string_ids(spark):
    rows = [("", 0, "user", "empty id"), (None, 0, "user", "null id"), ("=", 0, "user", "x")]
    out = cf.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    assert sorted((str(r.conv_id), r.n_turns) for r in out.collect()) == [("", 1), ("=", 1), ("None", 1)]


def ends_once(turns):
    return "<s>" + "".join(f"[{r}]{t}" for r, t in turns) + "</s>"


def forgets_thoughts(turns):
    """Only the last answer keeps what stands before its divider."""
    return "".join(f"[{r}]{t if i == len(turns) - 1 or r != 'assistant' else t.split('//')[-1]};" for i, (r, t) in enumerate(turns))


def default_system(turns):
    return ("" if turns and turns[0][0] == "system" else "[system]be nice;") + "".join(f"[{r}]{t};" for r, t in turns)


def trims(turns):
    return "".join(f"[{r}]{t.strip()};" for r, t in turns)


def upper_names(turns):
    return "".join(f"{i}:{r.upper()}: {t}\n" for i, (r, t) in enumerate(turns))


@pytest.mark.parametrize("template, rewritten, whole", [
    (ends_once, [0, 1, 2, 3], [0, 1, 2, 3]), (forgets_thoughts, [2], [0, 2, 3]), (default_system, [], [0, 1, 2, 3]),
    (trims, [], [0, 1, 3]), (upper_names, [], [0, 1, 2, 3])])
def test_templates(template, rewritten, whole):
    turns = [("user", "a"), ("assistant", "think//b"), ("user", " abba "), ("assistant", "c//end")]
    out, spans, found = cf.render(template, turns, escaped=lambda t: t)
    assert out == template(turns) and found == rewritten and [s[0] for s in spans] == whole if template is not forgets_thoughts else True
    for turn, start, low, high, end, loss in spans:
        assert out[low:high] == turns[turn][1] and start <= low <= high <= end and loss == (turns[turn][0] == "assistant")
    if template is forgets_thoughts:
        assert out == template(turns) and found == [2] and [s[0] for s in spans] == [0, 2, 3]  # turn 1 lost its thought


def test_default_system_rewrites_when_a_system_turn_comes():
    assert cf.render(default_system, [("system", "x"), ("user", "y")], escaped=lambda t: t)[2] == [0]


@pytest.mark.parametrize("a, b", [("", ""), ("a", "a"), ("abc", "abd"), ("x" * 1000, "x" * 999), ("x" * 1000 + "y", "x" * 1000 + "z"), ("q", "r"), ("", "z")])
def test_common(a, b):
    import os
    assert cf._common(a, b) == len(os.path.commonprefix([a, b]))


def test_formatted_through_another_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x//y"), (1, 2, "assistant", "z")],
                               "conv_id long, turn int, role string, text string")

    def local(turns):
        return "".join(f"[{r}]{t};" for r, t in turns) + "!"
    r = cf.format_chats(df, local, escaped=lambda t: t).withColumn("loss", cf.loss_text()).first()
    assert r.formatted == "[user]q;[assistant]x//y;[assistant]z;!" and r.rewritten == [0, 1, 2] and r.loss == "x//yz"
    assert hashlib.sha256(r.loss.encode()).hexdigest()
