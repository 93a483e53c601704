"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, then the mix.

Each stage takes (spark, docs, sf_dir) and returns documents with all their columns; the last adds size, taken (the words
that the mix takes from a document, repeats counted; documents of which it takes none are left out) and first_slot, the order in
which the mix is read. ``run`` writes each stage's result to the shared folder, deletes what the stage wrote for itself, and reads
the result again, so a lost executor costs one stage at most.

A null text is an empty one. Rows that repeat a doc_id are rows of their own: the first, second and fourth stage judge each by its
text, and of a group of copies one row stays. Extra columns go through unread, whatever they are called; the mix
renames the input's size, taken and first_slot to given_size and so on. An empty table gives an empty one.
"""

from quillspark.llm import decontaminate, exact_dedup, mixing, quality, simhash
from quillspark.llm.common import keep_only, table, written


def quality_stage(spark, docs, sf_dir):
    """Documents that the compression classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of documents that are equal but for white space one stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark, docs, sf_dir):
    """Of each component of near copies one document stays."""
    return simhash.near_dedup(docs)


def leak_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item, edited or not, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark, docs, sf_dir):
    """Sources are mixed to their target weights."""
    return mixing.mixed(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("leaks", leak_stage), ("mix", mix_stage)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, mark = table(spark, sf_dir, "documents"), len(written)
    for _, stage in STAGES[:-1]:
        docs = keep_only(stage(spark, docs, sf_dir), mark)
    return STAGES[-1][1](spark, docs, sf_dir)
