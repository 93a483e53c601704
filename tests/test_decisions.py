"""Operators of ``policy`` and ``relational`` that SQL doesn't tell: against plain Python."""

import random

from pyspark.sql import functions as F

from quillspark.functions import content
from quillspark.operators import policy, relational
from quillspark.plans import decisions


def _pruned(messages, window, keep, soft, hard, least, trim, cleared):
    """Plain steps over one conversation: (action, text) of each message."""
    size = lambda m, t: len(t) if m[0] in ("user", "assistant", "toolResult") else 256
    texts, out = [m[1] for m in messages], ["kept"] * len(messages)
    assistants = [k for k, m in enumerate(messages) if m[0] == "assistant"]
    if keep > 0 and len(assistants) < keep:
        return list(zip(out, texts))
    cutoff = assistants[-keep] if keep > 0 else len(messages)
    start = next((k for k, m in enumerate(messages) if m[0] == "user"), len(messages))
    total = lambda: sum(size(m, t) for m, t in zip(messages, texts))
    if total() < soft * window:
        return list(zip(out, texts))
    old = [k for k in range(start, cutoff) if messages[k][0] == "toolResult"]
    for k in old:
        n = len(texts[k])
        if n > trim[0] and trim[1] + trim[2] < n:
            texts[k] = f"{texts[k][:trim[1]]}\n...\n{texts[k][-trim[2]:]}\n\n[Tool result trimmed: kept first {trim[1]} chars and last {trim[2]} chars of {n} chars.]"
            out[k] = "trimmed"
    if total() >= hard * window and sum(len(texts[k]) for k in old) >= least:
        for k in old:
            if total() < hard * window:
                break
            texts[k], out[k] = cleared, "cleared"
    return list(zip(out, texts))


def test_pruning_against_plain_steps(spark):
    r = random.Random(3)
    rows, want = [], {}
    settings = dict(window=2600, keep=2, soft=0.3, hard=0.6, least=120, trim=(100, 30, 20), cleared="[gone]")
    for c in range(400):
        messages = [(r.choice(["user", "assistant", "toolResult", "toolResult", "other"]), "x" * r.choice([5, 40, 150, 600])) for _ in range(r.randrange(1, 14))]
        rows += [(c, k, m[0], m[1]) for k, m in enumerate(messages)]
        want.update({(c, k): v for k, v in enumerate(_pruned(messages, **settings))})
    d = spark.createDataFrame(rows, "c int, k int, role string, text string")
    got = relational.prune_context(d, "c", "k", "role", "text", F.lit(True), 2600, 2, 0.3, 0.6, 120, (100, 30, 20), "[gone]").collect()
    assert {(x.c, x.k): (x.action, x.text) for x in got} == want
    assert {a for a, _ in want.values()} == {"kept", "trimmed", "cleared"}


def test_emails_are_cleaned_and_ranked(spark):
    got = {r.id: r.e for r in spark.createDataFrame(decisions.MAILS, "id int, t string, host string").select("id", content.emails(F.col("t"), F.col("host"), ["b.example.com", "free.test"]).alias("e")).collect()}
    assert got == {-1: ["info@shop.test", "jo@shop.test", "no-reply@shop.test"], -2: [], -3: [], -4: ["x@sub.shop.test", "sales@other.test", "dot.@x.test", "dash-@x.test"]}
    long = spark.createDataFrame([("a" * 400_000,), ("a@" * 100_000,)], "t string").select(F.size(content.emails(F.col("t"), F.lit(""))).alias("n"))
    assert [r.n for r in long.collect()] == [0, 0]


def test_no_rules_and_empty_lists(spark):
    d = spark.createDataFrame([("a", None)], "x string, y string")
    row = d.select(
        policy.first_rule(None).alias("a"), policy.any_deny([], "deny").alias("b"), policy.glob_allowed(F.col("x"), [], []).alias("c"), policy.category_kept(["y"], "z").alias("d"),
        policy.category_kept(["y"], " , ").alias("e"), policy.allow_match(F.col("x"), F.col("y"), ["*"])["match_source"].alias("f"), policy.sender_allowed(F.col("y"), ["a"], True).alias("g"),
    ).first()
    assert tuple(row) == ("allow", "deny", True, False, True, "wildcard", False)
