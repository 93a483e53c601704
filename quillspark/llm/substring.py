"""Substring dedup with suffix automata.

A window is ``WINDOW`` consecutive words; every word in a window that also starts in a document with a smaller doc_id goes.
``repeats`` cuts the corpus into reference shards of bounded content: all contested segments whose minimizers fall in a
shard. For each shard one suffix automaton of its reference segments is built, and the shard's documents stream through it: the
matching statistic at a word is the length of the longest string ending there that the reference holds. Where it reaches the
window's length, the state of the last ``WINDOW`` words tells the smallest document that holds them. An automaton is sent only
to its shard's task, so its size is bounded by the shard's, and no automaton of the whole corpus exists anywhere.

Nulls: a null text has no words; see ``repeats`` for null and repeated doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import table
from quillspark.llm.repeats import Kind, without_repeats

WINDOW, GRAM = 13, 6


class SuffixAutomaton:
    """Of many sequences; ``least`` is the smallest number of a sequence that holds a state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 63]

    def _state(self, size: int, following: dict, link: int, least: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.least.append(least)
        return len(self.size) - 1

    def _clone(self, at: int, symbol, old: int) -> int:
        new = self._state(self.size[at] + 1, dict(self.next[old]), self.link[old], self.least[old])
        while at >= 0 and self.next[at].get(symbol) == old:
            self.next[at][symbol] = new
            at = self.link[at]
        self.link[old] = new
        return new

    def add(self, sequence, number: int) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = known if self.size[known] == self.size[last] + 1 else self._clone(last, symbol, known)
            else:
                made, at = self._state(self.size[last] + 1, {}, 0, number), last
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = made
                    at = self.link[at]
                if at >= 0:
                    old = self.next[at][symbol]
                    self.link[made] = old if self.size[old] == self.size[at] + 1 else self._clone(at, symbol, old)
                last = made
            self.least[last] = min(self.least[last], number)

    def finish(self) -> None:
        """Let each state know the documents of the longer strings that end in its own."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.least[state] < self.least[self.link[state]]:
                self.least[self.link[state]] = self.least[state]

    def statistics(self, sequence, window: int):
        """(position, smallest document) of each place where the last ``window`` symbols are known."""
        state = length = 0
        for k, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if (to := self.next[state].get(symbol)) is not None:
                state, length = to, length + 1
            if length >= window:
                while self.size[self.link[state]] >= window:
                    state = self.link[state]
                    length = self.size[state]
                yield k, self.least[state]


def decide(ids, firsts, counts, texts) -> list[int]:
    automaton, numbers = SuffixAutomaton(), {}
    rows = [[numbers.setdefault(w, len(numbers)) for w in t.split(b" ")] for t in texts]
    for doc, row in zip(ids.tolist(), rows):
        automaton.add(row, doc)
    automaton.finish()
    out = []
    for doc, row in zip(ids.tolist(), rows):
        mask = 0
        for k, least in automaton.statistics(row, WINDOW):
            if least < doc:
                mask |= 1 << (k - WINDOW + 1)
        out.append(mask)
    return out


KIND = Kind(words=True, window=WINDOW, gram=GRAM, within=False, decide=decide)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, kept of each document."""
    return without_repeats(docs, KIND).withColumnRenamed("n_tokens", "n_words")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")


QUERIES, ORACLES = {"op1_substring": op1_substring}, {}
