"""Markdown tables: cases, a round trip, a column with nulls, the query against its oracle."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import tables
from quillspark.plans import content

SF = "/root/testdata/sf0.001"
SIMPLE = "| Name | Value |\n|------|-------|\n| A    | 1     |\n| B    | 2     |"


@pytest.mark.parametrize("text, bullets", [
    (SIMPLE, "**A**\n• Value: 1\n\n**B**\n• Value: 2"),
    ("before\n" + SIMPLE + "\n\nafter", "before\n**A**\n• Value: 1\n\n**B**\n• Value: 2\n\nafter"),
    ("| F | S | P |\n|---|---|---|\n| Speed | Fast | Medium |", "**Speed**\n• S: Fast\n• P: Medium"),
    ("| Name | Value |\n|---|---|\n| A | |\n| B | 2 |", "**A**\n\n**B**\n• Value: 2"),
    ("a | b\n-|-\n_r_ | [l](https://example.com)\n> quote", "**_r_**\n• b: [l](https://example.com)\n> quote"),
    ("| one |\n|--|\n| x |\n|  |\n| y |", "• x\n• y"), ("| | v |\n|-|-|\n| | 3 |", "• v: 3"), ("|a|b|\n|-|-|", ""),
    *[(t, t) for t in ("", "a | b", "| a | b |\n|---|", "| a |\nno dashes |", "```\n" + SIMPLE + "\n```", "~~~\n" + SIMPLE, "    | a | b |\n    |---|---|", "| a\n|\n| -")],
])
def test_bullets(text, bullets):
    assert tables.convert(text, "bullets") == bullets


def test_code():
    text = "|**Bold**|n|m|\n|:-|-:|:-:|\n|`x` and _y_|[7](u)|c|\n|snake_case_name|100|longer|"
    want = "```\n| Bold            |   n |   m    |\n| --------------- | --- | ------ |\n| x and y         |   7 |   c    |\n| snake_case_name | 100 | longer |\n```"
    assert tables.convert(text, "code") == want and tables.convert(text, "off") == text and tables.convert(None, "code") is None


word = st.text("ab1 é|*`", max_size=6).map(str.strip)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.lists(word, min_size=k, max_size=k), min_size=1, max_size=5)))
def test_round_trip(rows):
    text = "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in rows)
    head, *body = text.split("\n")
    text = "\n".join([head, "|" + "---|" * len(rows[0]), *body])
    (_, got), = tables.blocks(text)
    assert got == rows


def test_column_and_query(spark):
    d = spark.createDataFrame([(SIMPLE,), (None,), ("",), ("x",)], "t string")
    assert [r[0] for r in d.select(tables.tables_converted(d.t, "bullets")).collect()] == ["**A**\n• Value: 1\n\n**B**\n• Value: 2", None, "", "x"]
    with pytest.raises(ValueError):
        tables.tables_converted(d.t, "html")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    query, sql = content.FRAMES["markdown_tables"]
    assert sorted(map(tuple, query(spark, SF).collect())) == sorted(con.sql(sql).fetchall())
