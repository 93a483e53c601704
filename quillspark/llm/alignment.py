"""Cross-tokenizer alignment through a dictionary of groups.

A text is read by two tokenizers; the byte offsets where tokens of both end cut it into groups, and all pairs of an A and a B token
of one group are linked. What links depends on the group's ids alone, so groups are interned: a task gives each
distinct pair of id lists a number, and texts become lists of numbers. Before that, a text is cut in units where neither
tokenizer can join what stands on both sides (before a space or a line feed after a visible character; no piece of B crosses
there, which ``Tools`` verifies), and a unit met before isn't tokenized again.

Texts travel in blocks of some ``BLOCK_BYTES``. A block sends one row for each of its distinct groups with the number of its
documents that hold it, and one row a document: so the most frequent group has as many rows as there are blocks, not documents, and
no key is hot. Distinct groups of the corpus expand their links once; a pair's count is the number of documents of its groups, less
what documents that hold it in several groups count twice (``again``, told by the tasks). Each group's sums over its links
come back to the blocks by the group's key, and a block's documents look them up by number, in one task a block.

A null or empty text, and one whose tokens don't give back a space and the text, has no tokens: zeros and an empty ``groups_sha256``.
A null doc_id is passed through; repeated rows are documents of their own. Extra columns are not read. An empty table gives
an empty result. A unit is encoded whole, so memory grows with the longest run without spaces and line feeds.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, materialize, rows_of, table

TOKENIZERS = "/opt/tokenizers"
BLOCK_BYTES, BLOCK_ROWS, UNITS, UNIT_BYTES, TOGETHER = 4 << 20, 4096, 1 << 20, 48 << 20, 256
CUT = re.compile(r"(?<=\S)(?=[ \n])")
KINDS = "block long, kind string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, place int, a array<int>, b array<int>, n long"


def files(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The two vocabularies, read by the driver and sent to the tasks (about 4 MB)."""
    return tuple(open(os.path.join(folder, name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Tools:
    """The tokenizers with the bytes of their entries."""

    def __init__(self, sent: tuple[bytes, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(sent[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=sent[1])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte stands for itself, the others for characters from 256 on
        hidden = [x for x in range(256) if x not in visible]
        byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}
        vocabulary = json.loads(sent[0])["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte.get(c, 0) for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)  # else a text is one unit

    def units(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both; a unit begins with a space, which B adds by itself (but not to an empty text), or with a line feed, where what B adds is dropped."""
        b = self.b.encode([u.removeprefix(" ") for u in units], num_threads=1)
        b = [ids or [self.space] if u[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for u, ids in zip(units, b)]
        return [(e.ids, ids) for e, ids in zip(self.a.encode_batch_fast(units, add_special_tokens=False), b)]

    def ends_of(self, unit: bytes, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Of each group the byte, the token of A and the token of B where it ends; None if the tokens don't give back the bytes."""
        if b"".join(map(self.a_bytes.__getitem__, a)) != unit or b"".join(map(self.b_bytes.__getitem__, b)) != unit:
            return None
        ends, theirs = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts = np.intersect1d(ends, theirs)
        return cuts, np.searchsorted(ends, cuts, "right"), np.searchsorted(theirs, cuts, "right")

    def groups(self, unit: bytes, a: list[int], b: list[int]) -> list[tuple] | None:
        """The ids of each group."""
        if (found := self.ends_of(unit, a, b)) is None:
            return None
        i, j = found[1].tolist(), found[2].tolist()
        return [(tuple(a[s:e]), tuple(b[t:f])) for s, e, t, f in zip([0, *i], i, [0, *j], j)]


@functools.lru_cache(maxsize=1)
def tools(sent: tuple[bytes, bytes]) -> Tools:
    """One set of tokenizers a worker process."""
    return Tools(sent)


class Interned:
    """Units and groups by number. A group's number lasts while a block is read; between blocks all are forgotten once they are many."""

    def __init__(self, tools: Tools):
        self.tools = tools
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, tuple[int, ...]] = {}  # the numbers of a unit's groups; none if its tokens don't give it back
        self.numbers: dict[tuple, int] = {}
        self.singles: dict[int, int] = {}  # of groups of one token each, by the code of the pair
        self.groups: list[tuple] = []
        self.written: list[str] = []
        self.sizes = np.zeros((1024, 2), np.int64)  # tokens of A and of B
        self.pairs: dict[int, list[int]] = {}  # the codes of a group's distinct pairs
        self.size = 0

    def full(self) -> bool:
        return len(self.units) > UNITS or self.size > UNIT_BYTES

    def number(self, group: tuple) -> int:
        if (k := self.numbers.get(group)) is None:
            k = self.numbers[group] = len(self.groups)
            self.groups.append(group)
            self.written.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
            if k == len(self.sizes):
                self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.sizes[k] = len(group[0]), len(group[1])
            self.size += 64 * (len(group[0]) + len(group[1]))
            if len(group[0]) == len(group[1]) == 1:
                self.singles[(group[0][0] << 32) + group[1][0]] = k
        return k

    def numbered(self, a: list[int], b: list[int], i: np.ndarray, j: np.ndarray) -> list[int]:
        """The numbers of the groups that end at the tokens ``i`` and ``j``; most are of one token each, and looked up by their code."""
        codes = (np.array(a, np.int64)[i - 1] << 32) + np.array(b, np.int64)[j - 1]
        single = (np.diff(i, prepend=0) == 1) & (np.diff(j, prepend=0) == 1)
        out = [self.singles.get(c) if one else None for c, one in zip(codes.tolist(), single.tolist())]
        if None in out:
            i, j = [0, *i.tolist()], [0, *j.tolist()]
            out = [self.number((tuple(a[i[k] : i[k + 1]]), tuple(b[j[k] : j[k + 1]]))) if n is None else n for k, n in enumerate(out)]
        return out

    def learn(self, units: list[str]) -> None:
        """Units that end visibly are tokenized together, some ``TOGETHER`` at a time, since what stands between them is a cut."""
        firm = [u for u in units if not u[-1].isspace()]
        runs = [firm[k : k + TOGETHER] for k in range(0, len(firm), TOGETHER)] + [[u] for u in units if u[-1].isspace()]
        for run, (a, b) in zip(runs, self.tools.encode(["".join(run) for run in runs])):
            whole = "".join(run).encode()
            found = self.tools.ends_of(whole, a, b)
            if found:
                numbers = self.numbered(a, b, *found[1:])
                last = np.searchsorted(found[0], np.cumsum([len(u.encode()) for u in run]), "right").tolist()
                self.units.update((u, tuple(numbers[s:e])) for u, s, e in zip(run, [0, *last], last))
            elif len(run) == 1:
                self.units[run[0]] = ()
            else:
                for unit, ids in zip(run, self.tools.encode(run)):
                    self.units[unit] = tuple(map(self.number, self.tools.groups(unit.encode(), *ids) or []))
            self.size += len(whole)

    def text(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, n_links, sha256, numbers of distinct groups, how often each occurs); None for a text without tokens."""
        units = self.tools.units(text)
        held = list(map(self.units.get, units))
        if None in held:
            self.learn(list({u: None for u, h in zip(units, held) if h is None}))
            held = [self.units[u] if h is None else h for u, h in zip(units, held)]
        if () in held:
            return None
        order = list(itertools.chain.from_iterable(held))
        digest = hashlib.sha256(";".join(map(self.written.__getitem__, order)).encode()).hexdigest()
        places, times = np.unique(np.array(order, np.int32), return_counts=True)
        a, b = self.sizes[places].T
        return int(times @ a), int(times @ b), len(order), int(times @ (a * b)), digest, places, times

    def again(self, places: np.ndarray):
        """The pairs that several of a document's distinct groups link, each as often as that is too many.

        Of two such groups at least one has more than two tokens."""
        wide = places[self.sizes[places].sum(axis=1) > 2].tolist()
        codes: list[int] = []
        for k in wide:
            if (mine := self.pairs.get(k)) is None:
                mine = self.pairs[k] = [(x << 32) + y for x in set(self.groups[k][0]) for y in set(self.groups[k][1])]
            codes += mine
        here = set(places.tolist()) if codes else ()
        for p, n in Counter(codes).items():
            n += self.singles.get(p) in here
            if n > 1:
                yield (p >> 32, p & 0xFFFFFFFF), n - 1


def encoded(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Rows of three kinds, written to the shared folder: documents, groups of a block, and pairs counted again."""
    sent = docs.sparkSession.sparkContext.broadcast(files(folder))
    names = [c.split()[0] for c in KINDS.split(", ")]
    zeros = 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int64)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        interned = Interned(tools(sent.value))
        rows, size, held, again = [], 0, Counter(), Counter()

        def flush():
            out = [{"block": block, "kind": "group", "place": k, "a": interned.groups[k][0], "b": interned.groups[k][1], "n": n} for k, n in held.items()]
            out += [{"block": block, "kind": "again", "a": [p[0]], "b": [p[1]], "n": n} for p, n in again.items()]
            out += rows
            rows.clear(), held.clear(), again.clear()
            if interned.full():
                interned.clear()
            for at in range(0, len(out), 10_000):
                part = out[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in part], kind) for c, kind in zip(names, types)], names=names)

        for batch in batches:
            for doc_id, text in rows_of(batch):
                n_a, n_b, n_groups, n_links, digest, places, times = (interned.text(text.decode("utf-8", "replace")) if text else None) or zeros
                held.update(places.tolist())
                for pair, n in interned.again(places):
                    again[pair] += n
                rows.append({"block": block, "kind": "doc", "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest, "places": places.astype(np.int32).tobytes(), "times": times.astype(np.int32).tobytes()})
                size += len(text or b"")
                if size >= BLOCK_BYTES or len(rows) == BLOCK_ROWS:
                    yield from flush()
                    block, size = block + 1, 0
        if rows:
            yield from flush()

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
    return materialize(documents(docs).mapInArrow(run, KINDS))


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of the distinct groups (a_ids, b_ids, a, b, m: how often the group links the pair), and the pairs (a, b, pair_count, best)."""
    group = rows.where("kind = 'group'").groupBy(F.col("a").alias("a_ids"), F.col("b").alias("b_ids")).agg(F.sum("n").alias("docs"))
    ids = lambda c: F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("id"), F.size(F.filter(c, lambda y: y == x)).cast("long").alias("m")))
    links = group.select("a_ids", "b_ids", "docs", F.explode(ids("a_ids")).alias("x")).select("a_ids", "b_ids", "docs", "x", F.explode(ids("b_ids")).alias("y"))
    links = materialize(links.select("a_ids", "b_ids", "docs", F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.m") * F.col("y.m")).alias("m")))
    twice = rows.where("kind = 'again'").select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), (-F.col("n")).alias("docs"))
    counts = links.select("a", "b", "docs").unionByName(twice).groupBy("a", "b").agg(F.sum("docs").alias("pair_count"))
    counts = materialize(counts)
    most = counts.groupBy("a").agg(F.max("pair_count").alias("most"))
    return links, counts.join(most, "a").select("a", "b", "pair_count", (F.col("pair_count") == F.col("most")).cast("long").alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row a document: its tokens, groups and links, how many links are their A id's most common, and the sum of their counts."""
    rows = encoded(docs, folder)
    links, counts = pair_counts(rows)
    values = links.join(counts, ["a", "b"]).groupBy("a_ids", "b_ids").agg(F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("pair_count")).alias("count_sum"))
    placed = rows.where("kind = 'group'").select("block", "place", F.col("a").alias("a_ids"), F.col("b").alias("b_ids"))
    placed = placed.join(values, ["a_ids", "b_ids"]).select(F.col("block").alias("of_block"), "place", "n_best", "count_sum")
    whole = rows.where("kind = 'doc'").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(place := right["place"].to_numpy())
        place, best, sums = place[order], right["n_best"].to_numpy()[order], right["count_sum"].to_numpy()[order]
        n_best, count_sum = [], []
        for mine, times in zip(left["places"].to_pylist(), left["times"].to_pylist()):
            at, n = np.searchsorted(place, np.frombuffer(mine, np.int32)), np.frombuffer(times, np.int32).astype(np.int64)
            n_best.append(int(n @ best[at]) if len(n) else 0)
            count_sum.append(int(n @ sums[at]) if len(n) else 0)
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", left["groups_sha256"])

    return whole.groupBy("block").cogroup(placed.groupBy("of_block")).applyInArrow(look_up, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op11_alignment": op11_alignment}, {}
