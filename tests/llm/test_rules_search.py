"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import alignment, quality_rules, search
from quillspark.llm.common import table, word_lists
from tests.llm.helpers import docs, rows, tokens, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def same(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, relation.select(*(f'"{c}"' for c in columns)).fetchall()))


# quality rules


def plain_rules(text):
    text = text or ""
    ws = tokens(text)
    n = len(ws)

    def inside(size, first):
        runs = [tuple(ws[k : k + size]) for k in range(n - size + 1)]
        count, seen, out = Counter(runs), set(), set()
        for k, run in enumerate(runs):
            if (count[run] > 1) if first else (run in seen):
                out.update(range(k, k + size))
            seen.add(run)
        return out

    out = {"n_words": n, "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_repeat_words": len(inside(5, True)), "n_dup_lines": 0, "dup_line_chars": 0}
    seen = set()
    for line in text.split("\n"):
        if tokens(line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += sum(map(len, tokens(line)))
            seen.add(line)
    for size in range(5, 11):
        out[f"dup_chars_{size}"] = sum(len(ws[k]) for k in inside(size, False))
    out["base_failed"] = n < 10 or 100 * out["n_repeat_words"] > 20 * n
    most = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    out["kept"] = not out["base_failed"] and all(100 * out[f"dup_chars_{k}"] <= v * out["word_chars"] for k, v in most.items()) and 100 * out["dup_line_chars"] <= 20 * out["word_chars"]
    return out


def test_rules_oracle(spark, oracle):
    same(quality_rules.op12_quality_rules(spark, SF), oracle.sql(quality_rules.SQL))


def test_rules_edges(spark):
    got = quality_rules.quality_rules(docs(spark))
    assert set(got.columns) == {"doc_id", *plain_rules("")}
    want = sorted(repr((r[0], sorted(plain_rules(r[1]).items()))) for r in rows())
    assert sorted(repr((r.doc_id, sorted((k, v) for k, v in r.asDict().items() if k != "doc_id"))) for r in got.collect()) == want
    assert quality_rules.quality_rules(docs(spark).limit(0)).count() == 0


def test_rules_random_texts():
    r = random.Random(5)
    for _ in range(150):
        parts = [" ".join(r.choice("abcé") for _ in range(r.randrange(0, 30))) for _ in range(4)]
        text = "".join(r.choice(parts) + r.choice([" ", "\n", "\n\n", "\r\n", "\x85"]) for _ in range(r.randrange(0, 8)))
        assert quality_rules.measured(text.encode()) == plain_rules(text)


def test_rules_method_decides():
    line = words(6, 1)
    text = words(80, 2) + f"\n{line}\n" + words(40, 3) + f"\n{line}\n" + words(20, 4)
    assert quality_rules.measured(text.encode())["kept"]  # one line said twice
    got = quality_rules.measured((words(30, 7, 10**6) + "\n" + "\n".join([words(3, 5)] * 20)).encode())
    assert not got["kept"]
    long = " ".join(f"u{k}" for k in range(83)) + f" {words(1, 9)} x y z q w e r t p" + " x y z q w e r t p"
    got = quality_rules.measured(long.encode())
    assert not got["base_failed"] and got["n_repeat_words"] == 18 and got["dup_chars_9"] == 9
    wide = "extraordinarily-long-word-" * 3
    got = quality_rules.measured((" ".join(f"u{k}" for k in range(100)) + f" {wide} a b c d e f g h i" * 2).encode())
    assert not got["base_failed"] and not got["kept"]  # few words, many characters


def test_rules_colliding_hashes():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    starts = np.arange(7)
    every, later = quality_rules.repeated_starts(ids, np.zeros(7, np.uint64), starts, 3)
    assert every.tolist() == [0, 6] and later.tolist() == [6]


def test_word_lists():
    text = (words(3000, 3) + "\n\t é \x0b").encode()
    assert [w for part in word_lists(text, 100) for w in part] == text.split() and list(word_lists(b"")) == []
    assert [w for part in word_lists(b"x" * 500, 100) for w in part] == [b"x" * 500]


def test_rules_stage_keeps_columns(spark):
    kept = quality_rules.keep_clean(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs(spark).collect() if plain_rules(r.text)["kept"])


# ranked search


def plain_search(documents, items, top=50):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(find(t))) for d, t in documents]
    held = [(d, c, c.total()) for d, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c, size in held:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(map(repr, out))


def test_search_oracle(spark, oracle):
    same(search.op13_ranked_search(spark, SF), oracle.sql(search.SQL))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("window, size, block", [(4096, 2 << 20, 8 << 20), (3, 2 << 20, 64), (4096, 40, 200)])
def test_search_edges(spark, monkeypatch, window, size, block):
    """Nulls, ties, repeated rows, long texts; windows and blocks of any size give the same result."""
    for name, value in (("WINDOW", window), ("WINDOW_BYTES", size), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(search, name, value)
    items = [(1, "w1 w2 W3 é"), (1, "w5"), (2, None), (3, ""), (4, "unknown-only qqq"), (None, "de x"), (5, "w7, w8; a_b"), (5, "w7, w8; a_b"), (6, "a" * 300)]
    table_ = spark.createDataFrame([(*x, 1, 1, "k") for x in items], "item_id long, text string, doc_id long, score long, key string")
    assert found(search.search(docs(spark).repartition(3), table_, top=4)) == plain_search([(r[0], r[1]) for r in rows()], items, 4)


def test_search_long_text_and_empty_tables(spark):
    long = words(300_000, 8) + " needle"
    data = [(1, long), (2, "needle"), (3, "É Ñ needle\x00needle"), (4, None)]
    documents = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(1, "Needle w5"), (2, "É")], "item_id long, text string")
    assert found(search.search(documents, items)) == plain_search(data, [(1, "Needle w5"), (2, "É")])
    assert search.search(documents.limit(0), items).count() == 0 == search.search(documents, items.limit(0)).count()


def test_search_ties(spark):
    data = [(k, "same words here") for k in range(200, 0, -1)] + [(500 + k, "other") for k in range(30)]
    got = search.search(spark.createDataFrame(data, "doc_id long, text string").repartition(7), spark.createDataFrame([(9, "words")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 51)) and [r["rank"] for r in got] == list(range(1, 51))


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")


def plain_alignment(texts, tokenizers):
    """Whole texts, all links, no dictionary: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each."""
    a, b = tokenizers
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_ = dict(zip(map(chr, visible), visible)) | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    a_bytes = {k: bytes(table_[c] for c in e) if all(c in table_ for c in e) else b"" for e, k in a.get_vocab().items()}

    def b_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    read = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and not b"".join(a_bytes[k] for k in x) == b"".join(map(b_bytes, y)) == (" " + text).encode():
            x, y = [], []
        ends = [np.cumsum([len(a_bytes[k]) for k in x]).tolist(), np.cumsum([len(b_bytes(k)) for k in y]).tolist()]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((x, y)):
            for k, end in zip(ids, ends[side]):
                groups[next(i for i in range(np.searchsorted(cuts, end), len(cuts)) if cuts[i] >= end)][side].append(k)
        read.append((x, y, groups))
    held = Counter()
    for _, _, groups in read:
        held.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for x, y, groups in read:
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        name = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(held[z] == most[z[0]] for z in links), sum(held[z] for z in links), hashlib.sha256(name.encode()).hexdigest() if x else ""))
    return out


ORDER = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(df):
    return sorted(repr(tuple(r)) for r in df.select(ORDER).collect())


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ of pieces", "日本語のテキスト と English", "a   b  c   d", "tab\tand\r\nlines\r\n\r\n end ;\r x", "\x1c\x1d \x1e a\x1f b", "''s 's don't I'll  we've",
    "\n\n\n", " ", "  two", "trailing   ", "emoji 👩‍👩‍👧 🏳️‍🌈 é", "x" * 3000, "ab" * 2000 + " " + "-" * 999, "  　 x　 y", "nul\x00 byte", "12345678901 1,000.50 %$#", "﻿bom ​ zero", "line\nline\n  indented\n\tcode = {};\r\n}",
]


def test_alignment_brute_force(spark, tokenizers):
    """All of the smallest table and odd texts: special strings, white space of all kinds, long runs, other scripts."""
    documents = table(spark, SF, "documents")
    data = [(r.doc_id, r.text) for r in documents.collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)]
    want = sorted(repr((d, *w)) for (d, _), w in zip(data, plain_alignment([t for _, t in data], tokenizers)))
    assert aligned(alignment.align(spark.createDataFrame(data, "doc_id long, text string").repartition(5))) == want
    assert sum("''" in w for w in want) == 1  # the one with a piece's space in it


@pytest.mark.parametrize("block, units", [(4 << 20, 1 << 18), (500, 10)])
def test_alignment_edges(spark, tokenizers, monkeypatch, block, units):
    """Nulls, ties, repeated rows, clashing columns; small blocks that forget units give the same result."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "UNITS", units)
    want = plain_alignment([r[1] for r in rows()], tokenizers)
    assert aligned(alignment.align(docs(spark))) == sorted(repr((r[0], *w)) for r, w in zip(rows(), want))
    assert alignment.align(docs(spark).limit(0)).count() == 0


def test_alignment_counts_a_document_once(spark, tokenizers):
    """A pair that several distinct groups of one document link counts that document once."""
    data = [(1, "aaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (2, "aaaaaaaaaaaaa"), (3, "naïve naïveté ïï ïïï ïïïï")]
    want = plain_alignment([t for _, t in data], tokenizers)
    assert aligned(alignment.align(spark.createDataFrame(data, "doc_id long, text string"))) == sorted(repr((d, *w)) for (d, _), w in zip(data, want))
    tools = alignment.Tools(alignment.files())
    assert tools.cuts and any(len(g[0]) * len(g[1]) > 1 for u in tools.units(data[0][1]) for g in tools.groups(u.encode(), *tools.encode([u])[0]))


def test_units_change_no_token(tokenizers):
    a, b = tokenizers
    tools = alignment.Tools(alignment.files())
    r = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "X", "é", "日", ".", "''", "'s", "9", " ", "　", "\x1c", "́", "👩", ";\r", " "]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))
        ids = tools.encode(tools.units(text))
        assert [k for x, _ in ids for k in x] == a.encode(" " + text, add_special_tokens=False).ids
        assert [k for _, y in ids for k in y] == b.encode(text)
