"""Rows on which every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size long, taken long, number int, _kept_id long, rep long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    base = words(60, 1)
    long = words(6000, 2)
    passage = words(25, 3)
    texts = [
        base, base, base.replace("w1", "W1"), "", None, " \t\n\x0b\x0c\r", "one", "one two three four", "x " * 500, "de " * 300,
        long, long + " tail", words(40, 4) + " " + passage + " " + words(40, 5), words(30, 6) + "\n" + passage, passage, base + "\n\n" + base,
        "ñ é ü   nb sp " + passage, words(80, 7), words(80, 7) + " x", "a" * 300, "a" * 250 + "b" * 250, passage.upper(),
    ]
    out = [(k, t, "en", ["s1", "s2", "s3", None][k % 4], len(t or ""), 7, "k", 1, 1, 1, 1, 1) for k, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, base, "en", "s1", len(base), 7, "k", 1, 1, 1, 1, 1))
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
