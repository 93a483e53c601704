"""Sources, merges, schedules and markup on small inline cases."""

import json
import random
from datetime import datetime, timezone


import pytest

from quillspark.functions import schedules
from quillspark.functions import text as text_functions
from quillspark.operators import matching, stateful
from quillspark.sources import sinks, tables


def _ms(*at):
    return int(datetime(*at, tzinfo=timezone.utc).timestamp() * 1000)


def test_merge_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", "d", None]), i, rng.random() < 0.2, rng.choice(["x", "y", "", None]), rng.choice(["", None, "s", "long", "rang", "longest"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, detail boolean, plain string, text string").repartition(4)
    got = {r.k: (r.plain, r.text, r.detail, r.sightings) for r in matching.merge_sightings(df.where("k is not null"), "k", "seq", "detail", ["plain"], ["text"]).collect()}
    want = {}
    for k, _, detail, *values in rows:
        if k is None:
            continue
        before = want.get(k)
        if before is None:
            want[k] = [*[v or None for v in values], detail, 1]
            continue
        over = detail and not before[2]
        for i, v in enumerate(values):
            if v and (over or not before[i] or (i == 1 and len(v) > len(before[i]))):
                before[i] = v
        before[2], before[3] = before[2] or detail, before[3] + 1
    assert got == {k: tuple(v) for k, v in want.items()}
    assert matching.merge_sightings(df, "k", "seq", "detail", ["plain"], ["text"]).where("k is null").count() == sum(r[0] is None for r in rows)


def test_contained_equals_brute_force(spark):
    docs = [(1, "one two three four"), (2, "x one two threefold y"), (3, None), (4, ""), (5, "zzone two three"), (6, "short")]
    items = [(10, "one two three"), (11, "short"), (12, "two  three"), (13, None), (14, "e two threef")]
    got = matching.contained(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 5)
    want = {(d, i) for d, t in docs for i, u in items if t is not None and u is not None and len(u) >= 5 and u in t}
    assert {tuple(r) for r in got.collect()} == want and len(got.collect()) == len(want)


def test_cron():
    now = _ms(2024, 1, 31, 10, 7)
    assert schedules.next_run("*/15 * * * *", now) == _ms(2024, 1, 31, 10, 15)
    assert schedules.next_run("0 0 1 * *", now) == _ms(2024, 2, 1)
    assert schedules.next_run("0 9 * * mon-fri", _ms(2024, 2, 2, 9)) == _ms(2024, 2, 5, 9)
    assert schedules.next_run("0 0 13 * 5", now) == _ms(2024, 2, 2)  # either the 13th or a Friday
    assert schedules.next_run("0 0 29 2 *", _ms(2024, 3, 1)) == _ms(2028, 2, 29)
    assert schedules.next_run("0 0 30 2 *", now) is None and schedules.next_run("61 * * * *", now) is None and schedules.next_run("* * *", now) is None
    assert schedules.next_run("30 2 * * *", _ms(2024, 3, 31, 0, 0), "Europe/Berlin") == _ms(2024, 4, 1, 0, 30)  # 02:30 doesn't exist on March 31


def test_cron_udf(spark):
    df = spark.createDataFrame([("0 0 * * *", _ms(2024, 1, 1, 1)), ("bad", 0), (None, 0), ("* * * * *", None)], "e string, n long")
    assert [r[0] for r in df.select(schedules.next_cron_ms()("e", "n")).collect()] == [_ms(2024, 1, 2), None, None, None]


def test_visible_text():
    html = '<p>a<br>b</p><div hidden>c<div>d</div>e</div><span style="display: none">f</span><i class="x sr-only">g</i><script>h</script><!-- i --><b style="width:0;height:0;overflow:hidden">j</b><img hidden>k &amp; l'
    assert schedules.visible_text_of(html) == "a b k & l" and schedules.visible_text_of("") == ""


def test_code_spans():
    text = "a `b` c\n```py\nx `y`\n```\nend ``d ` e``\n~~~\nopen"
    assert [text[a:b] for a, b in schedules.code_spans(text)] == ["`b`", "```py\nx `y`\n```\n", "``d ` e``", "~~~\nopen"]


def test_sources(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(json.dumps({"id": "a", "channel": "c", "to": "t", "enqueuedAt": 5, "retryCount": 0}))
    (tmp_path / "q" / "b.json").write_text(json.dumps({"id": "b", "channel": "c", "to": "t", "enqueuedAt": 2, "retryCount": 1}))
    (tmp_path / "q" / "c.json").write_text("{broken")
    assert [r.id for r in tables.pending_deliveries(spark, str(tmp_path / "q")).collect()] == ["b", "a"]
    (tmp_path / "r.json").write_text(json.dumps({"testResults": [{"name": "f", "assertionResults": [{"fullName": "t", "status": "passed", "duration": 3.5}]}]}))
    assert [tuple(r) for r in tables.test_reports(spark, str(tmp_path / "r.json")).collect()] == [("f", "t", "passed", 3.5)]
    (tmp_path / "c.json").write_text(json.dumps([{"provider": "p", "daily": [{"date": "2024-01-01", "modelBreakdowns": [{"modelName": "m", "cost": 1.5}]}]}, {"provider": "z", "daily": []}]))
    assert [tuple(r) for r in tables.cost_log(spark, str(tmp_path / "c.json"), "p").collect()] == [("2024-01-01", "m", 1.5)]
    for name in ("one", "two"):
        (tmp_path / name).write_text(json.dumps({f"{name}:k": {"sessionId": name, "updatedAt": len(name) + (name == "two")}}))
    assert [r.session_id for r in tables.all_stores(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()] == ["two", "one"]
    (tmp_path / "app-2024-01-01.log").write_text("x")
    (tmp_path / "other.log").write_text("y")
    assert [r.path.rsplit("/", 1)[-1] for r in tables.latest_log(spark, str(tmp_path)).collect()] == ["app-2024-01-01.log"]


def test_markdown_of_html():
    html = "<title> T &amp; U </title><h2>Head <b>two</b></h2><p>See <a href='http://x/'>the <i>site</i></a><br>and <a href='/y'></a></p><ul><li>one</li><li></li></ul><script>z</script>"
    assert schedules.markdown_of(html) == ("T & U", "T & U\n## Head two\nSee [the site](http://x/)\nand /y\n\n- one")
    assert schedules.markdown_of("") == (None, "")


def test_redaction(spark):
    long = "abcdefghijklmnopqrst"
    cases = {
        f"API_KEY={long} x": "API_KEY=abcdef…qrst x", "my_token: 'short' y": "my_token: '***' y", f'{{"token": "{long}"}}': '{"token": "abcdef…qrst"}', "--password hunter2 run": "--password *** run",
        f"Authorization: Bearer {long}": "Authorization: Bearer abcdef…qrst", f"Bearer {long}.": "Bearer abcdef…qrst.", "Bearer short": "Bearer short", "use sk-12345678 now": "use *** now",
        "use sk-1234567890abcdefgh now": "use sk-123…efgh now", f"ghp_{long}12": "ghp_ab…st12", f"github_pat_{long}": "github…qrst", "/bot123456:" + long + "/x": "/bot123456…qrst/x",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----": "-----BEGIN RSA PRIVATE KEY-----\n…redacted…\n-----END RSA PRIVATE KEY-----", "plain text": "plain text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", text_functions.redact_all(df.t)).collect()} == cases


def test_user_patterns(spark):
    for good in (r"id-\d+", "(ab)?c*", "a{2,3}b+", "(a|b)+"):
        assert text_functions.safe_pattern(good), good
    for bad in ("(a+)+", "(a*)*b", "((x|y+)z)*", "(", "(a{2,}){3}"):
        assert not text_functions.safe_pattern(bad), bad
    df = spark.createDataFrame([("id-12 ok",)], "t string")
    assert df.select(text_functions.redact_with(df.t, [r"id-\d+"])).first()[0] == "*** ok"
    with pytest.raises(ValueError):
        text_functions.redact_with(df.t, ["(a+)+"])


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("a.txt", 4000), ("b.txt", 1), ("empty.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 5 else "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.numbered_lines(spark, str(tmp_path), "*.txt")
        assert rows.rdd.getNumPartitions() > 1
        got = {(r.file.rsplit("/", 1)[-1], r.line): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.txt", i): f"a.txt {i}" if i % 5 else "" for i in range(1, 4001)} | {("b.txt", 1): "b.txt 1"}


def test_publish_keeps_the_old_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.publish(spark.range(3), folder) == 1
    with pytest.raises(Exception, match="boom"):
        sinks.publish(spark.range(5).selectExpr("if(id = 4, raise_error('boom'), id) as id"), folder)
    assert sinks.published(spark, folder).count() == 3
    assert sinks.publish(spark.range(0), folder) == 2 and sinks.published(spark, folder).count() == 0


def test_remembered_equals_the_store(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["n", " ", None]), rng.choice([" a", "b", "c", "d", "", None]), i * rng.choice([1, 1, 2]) // 2 * 10) for i in range(200)]
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    for ttl, most in ((60, 2), (0, 3), (100, 100)):
        stores, want = {}, {}
        for i, space, key, at in rows:
            held, key = stores.setdefault((space or "").strip() or "global", {}), (key or "").strip()
            want[i] = bool(key) and key in held and (ttl == 0 or at - held[key][0] < ttl)
            if key and not want[i]:
                held[key] = (at, i)
                for k in [k for k, (seen, _) in held.items() if ttl and at - seen >= ttl]:
                    del held[k]
                for k in sorted(held, key=held.get)[: max(0, len(held) - most)]:
                    del held[k]
        df = spark.createDataFrame(rows, "id long, space string, key string, ms long").repartition(3)
        assert {r.id: r.duplicate for r in stateful.remembered(df, "space", "key", "ms", "id", ttl, most).collect()} == want
