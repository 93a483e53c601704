"""Suffix-array dedup by deep-shallow sorting.

Every byte in a ``WINDOW``-byte string that also starts earlier (smaller doc_id, or an earlier start in the same document)
goes. ``repeats`` deals the suffixes (of which the first ``WINDOW`` bytes count) to shards by their minimizers; a shard puts its own
in order. A multikey quicksort on eight bytes at a time splits each group in three at its pivot, all groups of a round at once,
down to ``SHALLOW`` bytes. A blind trie orders each group that is still tied: it holds the positions at which its strings branch;
a string goes down blindly to one leaf, is compared with that one string, and either joins it or branches where they first
differ, and the branches in byte order give the group's order and the longest common prefixes of its neighbours. Runs of
neighbours with a common prefix of ``WINDOW`` bytes are equal strings; all but the earliest repeat.

Nulls: a null text is empty; see ``repeats`` for null and repeated doc_id. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import table
from quillspark.llm.repeats import Kind, without_repeats

WINDOW, GRAM, SHALLOW = 100, 50, 24


class BlindTrie:
    """Strings of equal length. A leaf is a list: the string, and the members that have it in the order they came."""

    def __init__(self):
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [text, member]
            return
        node = self.root
        while type(node) is tuple:
            at, branches = node
            node = branches.get(text[at]) or next(iter(branches.values()))
        if node[0] == text:
            node.append(member)
            return
        leaf, differ, half = node[0], 0, len(text)
        while half - differ > 1:  # the longest common prefix, by bisection
            middle = (differ + half) // 2
            if leaf[:middle] == text[:middle]:
                differ = middle
            else:
                half = middle
        above, node = None, self.root
        while type(node) is tuple and node[0] < differ:
            above, node = (node[1], text[node[0]]), node[1][text[node[0]]]
        if type(node) is tuple and node[0] == differ:
            node[1][text[differ]] = [text, member]
            return
        made = (differ, {leaf[differ]: node, text[differ]: [text, member]})
        if above is None:
            self.root = made
        else:
            above[0][above[1]] = made

    def ordered(self):
        """(member, bytes it shares with the one before) in the order of the strings."""
        open_nodes = [(self.root, 0)] if self.root is not None else []
        while open_nodes:
            node, shared = open_nodes.pop()
            if type(node) is list:
                yield node[1], shared
                for member in node[2:]:
                    yield member, len(node[0])
            else:
                at, branches = node
                below = [branches[c] for c in sorted(branches)]
                open_nodes += [(x, at) for x in below[:0:-1]] + [(below[0], shared)]


def _words_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as a number in the bytes' order."""
    return np.ascontiguousarray(data[starts[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings by their first ``depth`` bytes (a multiple of 8), and where in it a group of equal ones begins.

    Stable: equal strings stay in the order given."""
    n = len(starts)
    order, begins, at = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    begins[:1] = True
    word = _words_at(data, starts) if n else np.zeros(0, np.uint64)
    places = np.arange(n) if n > 1 else np.arange(0)
    while len(places):
        first = np.flatnonzero(begins[places])
        size = np.diff(np.append(first, len(places)))
        which = np.repeat(np.arange(len(first)), size)
        own, pivot = word[places], word[places[first + size // 2]][which]
        part = which * 3 + (own >= pivot) + (own > pivot)
        turn = np.argsort(part, kind="stable")
        order[places], word[places], part = order[places[turn]], own[turn], part[turn]
        edge = np.ones(len(places), bool)
        edge[1:] = part[1:] != part[:-1]
        begins[places] |= edge
        equal = part % 3 == 1
        at[places[equal]] += 8
        size = np.diff(np.append(np.flatnonzero(edge), len(places)))
        left = (np.repeat(size, size) > 1) & (at[places] < depth)
        places, equal = places[left], equal[left]
        deeper = places[equal]
        word[deeper] = _words_at(data, starts[order[deeper]] + at[deeper])
    return order, begins


def suffix_array(data: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``window``-byte strings at these starts, and the bytes each shares with the one before it
    (0 where the shallow sort already parts them)."""
    order, begins = multikey_quicksort(data, starts)
    shared, body = np.zeros(len(order), np.int64), data.tobytes()
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(order)))
    for at, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
        trie = BlindTrie()
        for member, start in zip(order[at : at + n].tolist(), starts[order[at : at + n]].tolist()):
            trie.add(body[start : start + window], member)
        order[at : at + n], shared[at : at + n] = zip(*trie.ordered())
    return order, shared


def decide(ids, firsts, counts, texts) -> list[int]:
    """Masks of the windows that start earlier; the segments come in order of (id, first window)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    seg = np.repeat(np.arange(len(texts)), counts)
    begin = firsts[seg] + nth
    corpus = np.lexsort((begin, ids[seg]))  # segments of one id can overlap only if it has several texts
    seg, nth, begin = seg[corpus], nth[corpus], begin[corpus]
    order, shared = suffix_array(data, (np.cumsum(lengths) - lengths)[seg] + nth)
    lead = np.maximum.accumulate(np.where(shared < WINDOW, np.arange(len(order)), 0))
    a, b = order, order[lead]  # the earliest of a run leads it, as equal strings stay in corpus order
    repeats = a[(ids[seg[a]] > ids[seg[b]]) | ((ids[seg[a]] == ids[seg[b]]) & (begin[a] > begin[b]))]
    masks = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(masks, seg[repeats], np.uint64(1) << nth[repeats].astype(np.uint64))
    return masks.tolist()


KIND = Kind(words=False, window=WINDOW, gram=GRAM, within=True, decide=decide, shards=2)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of each document."""
    return without_repeats(docs, KIND).withColumnRenamed("n_tokens", "n_bytes")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES, ORACLES = {"op4_suffix_array": op4_suffix_array}, {}
