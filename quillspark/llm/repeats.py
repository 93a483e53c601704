"""Windows that also start earlier in the corpus: the plan that substring dedup and suffix-array dedup share.

1. Each task cuts its documents into segments (``windows``); a segment goes by its minimizer, a rolling hash that only deals
   segments to buckets, and its name, 128 bits of BLAKE2b over its bytes, which alone says that two segments are equal. Of
   equal segments of a task only the first document's go on; the later ones are known to be repeats.
2. Names meet by minimizer. Later occurrences of a segment are repeats; minimizers with several different segments are
   contested: some of their windows may be equal.
   A minimizer with over ``hot`` different segments (a phrase that very many documents hold) is not sent to one shard: its
   segments are cut into single windows, each a segment of its own that goes to the shard of its own hash.
3. The first occurrence of each contested segment is sent, with its text, to its minimizer's shard, where the operator's own
   method (``decide``) finds which of its windows start earlier in another one.
4. Documents meet the verdicts on them, and lose what repeated windows cover.

What is shuffled beside the text (twice, by blocks of documents) is a packed entry of about 25 bytes for a segment. A name that
all documents share comes once from each task. Blocks, buckets and shards grow with the input's bytes, whatever the session's
number of partitions is. ``decided`` counts the windows that names and the method decide.

Documents of one doc_id count as one document, a null doc_id as the largest, a null text as empty. Rows of one doc_id with
different texts are told apart by 32 bits of their SHA-256, which no text of another doc_id meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, materialize, mixed, prefix_hash
from quillspark.llm.windows import segments, twice

LAST_ID = (1 << 63) - 1
FLUSH = 12 << 20  # bytes of text in a task's memory at a time
HOT = 0x80  # in a request's number of windows: its minimizer is hot
OWN = 0x80  # in an entry's number of windows: the segment may hold a window twice
BLOCK_BYTES, BUCKET_BYTES = 128 << 20, 64 << 20  # text of a block of documents, and text whose names make a bucket or a shard
ENTRY = ("<u8", "<u8", "<u8", "<i8", "<u4", "<u4", "u1")  # minimizer, name (two), id, check of the text, first window, windows
VERDICT = ("<i8", "<u4", "<u4", "<u8")  # id, check, first window, mask of the windows
REQUEST = ("<u8", "<i8", "<u4", "<u4", "u1")  # key, id, check, first window, windows


@dataclass(frozen=True)
class Kind:
    """What a token and a window are, and who decides contested windows.

    ``decide(ids, firsts, counts, texts)`` gets the contested segments of a shard in order of (id, first window) and returns,
    for each, the mask of the windows that also start in an earlier one."""

    words: bool
    window: int
    gram: int
    within: bool  # a document's own earlier windows count too
    decide: Callable
    hot: int = 1000
    shards: int = 16  # for each shuffle partition; a block sends a packed row to each shard it has segments for


def pack(arrays) -> bytes:
    """Columns as byte planes, so that bytes that hardly vary take no room."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays), 1)


def unpack(blobs, kinds) -> list[np.ndarray]:
    parts, width = [[] for _ in kinds], sum(np.dtype(k).itemsize for k in kinds)
    for blob in blobs:
        data, at = np.frombuffer(zstandard.decompress(blob), np.uint8), 0
        n = len(data) // width
        for part, kind in zip(parts, kinds):
            size = np.dtype(kind).itemsize
            part.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
            at += n * size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


class Tokens:
    """A document's tokens over its bytes (words: joined by one space)."""

    def __init__(self, text: bytes, words: bool):
        self.words = words
        if words:
            self.list = text.split()
            self.data = np.frombuffer(b" ".join(self.list), np.uint8)
            space = np.flatnonzero(self.data == 32)
            self.n = len(self.list)
            self.starts, self.ends = np.concatenate(([0], space + 1)), np.concatenate((space, [len(self.data)]))
        else:
            self.data = np.frombuffer(text, np.uint8)
            self.n = len(text)

    def lo(self, k):
        return self.starts[k] if self.words else k

    def hi(self, k):
        """End of token k."""
        return self.ends[k] if self.words else k + 1

    def segments(self, window: int, gram: int, within: bool):
        """(minimizer, name, name, first window, windows) of the segments."""
        if self.n < window:
            return [np.zeros(0, k) for k in ("<u8", "<u8", "<u8", "<i8", "u1")]
        sums, inverse = prefix_hash(self.data)
        at = np.arange(self.n - gram + 1)
        a, b = self.lo(at), self.hi(at + gram - 1)
        grams = mixed((sums[b] - sums[a]) * inverse[a])
        key, first, count = segments(grams, window, gram)
        own = twice(grams, key, first, count, window - gram + 1) if within else np.zeros(len(key), bool)
        name = self.names(first, count, window)
        return key & np.uint64((1 << 48) - 1), name[:, 0], name[:, 1], first, (count | np.where(own, OWN, 0)).astype("u1")

    def names(self, first, count, window) -> np.ndarray:
        """128 bits of BLAKE2b of each segment, as two columns."""
        body, digest = self.data.tobytes(), hashlib.blake2b
        ends = zip(self.lo(first).tolist(), self.hi(first + count + window - 2).tolist())
        return np.frombuffer(b"".join([digest(body[x:y], digest_size=16).digest() for x, y in ends]), "<u8").reshape(-1, 2)

    def span(self, first: int, tokens: int) -> bytes:
        return self.data[int(self.lo(first)) : int(self.hi(first + tokens - 1))].tobytes()


def check_of(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:4], "little")


def _full(counts: np.ndarray) -> np.ndarray:
    """The mask of all windows of a segment."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - counts.astype(np.uint64))


def _groups(*columns) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _packed(group: np.ndarray, arrays, by=()):
    """(number, packed arrays) of each number in ``group``, their rows in the order of ``by``."""
    order = np.lexsort((*by, group)) if by else np.argsort(group, kind="stable")
    if len(order):
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            yield int(group[own[0]]), pack([a[own] for a in arrays])


def _repeated(kind: Kind, entries):
    """Of sorted entries: who repeats an earlier equal segment, and who goes on."""
    _, hi, lo, ids, _, first, _ = entries
    new = _groups(hi, lo)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids > ids[lead]) | (kind.within & (first > first[lead]) & (ids == ids[lead]))
    return later, new if kind.within else ~later


def _sorted(entries):
    key, _, lo, ids, _, first, _ = entries
    order = np.lexsort((first, ids, lo, key))
    return [a[order] for a in entries]


def _verdicts(entries, which, blocks):
    _, _, _, ids, check, first, count = (a[which] for a in entries)
    return [(1, b, blob) for b, blob in _packed(ids % blocks, (ids, check, first, _full(count & ~np.uint8(OWN))), (first, ids))]


_ROWS = "what int, number int, blob binary"


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["what", "number", "blob"],
    )


def _cut(kind: Kind, buckets: int, blocks: int):
    def flush(held):
        entries = _sorted([np.concatenate(x) for x in zip(*held)])
        later, go_on = _repeated(kind, entries)
        sent = [a[go_on] for a in entries]
        # a document's entries lie together, so that its id and check take next to no room
        rows = [(0, b, blob) for b, blob in _packed((sent[0] % np.uint64(buckets)).astype(np.int64), sent, (sent[3],))]
        # repeats already known pass through any bucket
        return _batch(rows + _verdicts(entries, later, blocks))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text:
                    key, hi, lo, first, count = Tokens(text, kind.words).segments(kind.window, kind.gram, kind.within)
                    if len(key):
                        n = len(key)
                        held.append((key, hi, lo, np.full(n, ids[k].as_py(), "<i8"), np.full(n, check_of(text), "<u4"), first.astype("<u4"), count))
                        size += len(text)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _meet(kind: Kind, blocks: int):
    """A bucket of names: verdicts (1) and requests for texts (2), by block."""

    def run(group: pa.Table) -> pa.Table:
        known = [(1, b, blob) for w, b, blob in zip(*(group.column(c).to_pylist() for c in ("what", "number", "blob"))) if w == 1]
        blobs = [blob for w, blob in zip(group.column("what").to_pylist(), group.column("blob").to_pylist()) if w == 0]
        entries = _sorted(unpack(blobs, ENTRY))
        if not len(entries[0]):
            return pa.Table.from_batches([_batch(known)])
        later, _ = _repeated(kind, entries)
        key, hi, lo, ids, check, first, count = entries
        which = np.cumsum(_groups(key)) - 1
        contested = ((np.bincount(which, _groups(key, hi, lo)) > 1)[which] | (count & OWN > 0)) & ~later
        rows = known + _verdicts(entries, later, blocks)
        hot = (np.bincount(which, contested) > kind.hot)[which]
        count = ((count & ~np.uint8(OWN)) | np.where(hot, HOT, 0)).astype("u1")
        rows += [(2, b, blob) for b, blob in _packed(ids[contested] % blocks, [a[contested] for a in (key, ids, check, first, count)], (first[contested], ids[contested]))]
        return pa.Table.from_batches([_batch(rows)])

    return run


def _rows_with(docs: pa.Table, kinds, blobs):
    """Each document of a block with its rows of the packed arrays (id and check lead them but for a key)."""
    arrays = unpack(blobs, kinds)
    at = kinds.index("<i8")
    order = np.argsort(arrays[at], kind="stable")
    arrays = [a[order] for a in arrays]
    own = docs.column("id").to_numpy()
    lo, hi = np.searchsorted(arrays[at], own), np.searchsorted(arrays[at], own, "right")
    again = np.zeros(len(own), bool)
    _, back, uses = np.unique(own, return_inverse=True, return_counts=True)
    again = uses[back] > 1
    texts = docs.column("text")
    for k in range(docs.num_rows):
        text, mine = texts[k].as_py() or b"", [a[lo[k] : hi[k]] for a in arrays]
        if again[k] and len(mine[0]):  # rows of this id may be meant for another text
            fits = mine[at + 1] == np.uint32(check_of(text))
            mine = [a[fits] for a in mine]
        yield k, text, mine


def _single(kind: Kind, tokens: Tokens, ids, check, first, count):
    """The windows of segments, each as a segment of one window with its own name for a key."""
    n = count.astype(np.int64)
    at = np.repeat(first.astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    name = tokens.names(at, np.ones(len(at), np.int64), kind.window)[:, 0]
    return [(k, ids[0], check[0], a, 1, tokens.span(a, kind.window)) for k, a in zip(name, at.tolist())]


def _fetch(kind: Kind, shards: int):
    """The texts of contested segments, by shard."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asked.num_rows:
            for _, text, (key, ids, check, first, count) in _rows_with(docs, REQUEST, asked.column("blob").to_pylist()):
                if len(key):
                    tokens = Tokens(text, kind.words)
                    hot, count = count & HOT > 0, count & ~np.uint8(HOT)
                    if hot.any():
                        found += _single(kind, tokens, *(a[hot] for a in (ids, check, first, count)))
                    for k in np.flatnonzero(~hot).tolist():
                        found.append((key[k], ids[k], check[k], first[k], count[k], tokens.span(int(first[k]), int(count[k]) + kind.window - 1)))
        rows = []
        if found:
            arrays = [np.array([x[i] for x in found], t) for i, t in enumerate(REQUEST)]
            shard = (arrays[0] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                texts = [found[k][5] for k in own.tolist()]
                sizes = np.array([len(t) for t in texts], "<u4")
                rows.append((int(shard[own[0]]), pack([*(a[own] for a in arrays), sizes]), zstandard.compress(b"".join(texts), 1)))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "blob", "texts"])

    return run


def _settle(kind: Kind, blocks: int):
    """A shard's contested segments: verdicts, by block; with them a row (4) of the windows judged and found."""

    def run(group: pa.Table) -> pa.Table:
        _, ids, check, first, count, size = unpack(group.column("blob").to_pylist(), (*REQUEST, "<u4"))
        body = b"".join(zstandard.decompress(x) for x in group.column("texts").to_pylist())
        ends = np.cumsum(size.astype(np.int64))
        order = np.lexsort((check, first, ids))
        order = order[_groups(ids[order], first[order], check[order])]  # rows that repeat are one
        texts = [body[ends[k] - size[k] : ends[k]] for k in order.tolist()]
        ids, check, first, count = (a[order] for a in (ids, check, first, count))
        mask = np.array(kind.decide(ids, first.astype(np.int64), count.astype(np.int64), texts), np.uint64)
        some = mask > 0
        arrays = [a[some] for a in (ids, check, first, mask)]
        judged = pack([np.array([count.sum(), np.bitwise_count(mask).sum()], "<i8")])
        return pa.Table.from_batches([_batch([(3, b, blob) for b, blob in _packed(arrays[0] % blocks, arrays)] + [(4, 0, judged)])])

    return run


def covered(tokens: int, first: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which tokens lie in a repeated window."""
    bits = (mask[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    row, at = np.nonzero(bits)
    start = first[row].astype(np.int64) + at
    edge = np.zeros(tokens + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(kind: Kind):
    def run(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        given = docs.column("doc_id").to_pylist()
        out = []
        for k, text, (_, _, first, mask) in _rows_with(docs, VERDICT, verdicts.column("blob").to_pylist()):
            if not len(first):  # the common case: nothing repeats
                tokens = text.split() if kind.words else text
                kept = b" ".join(tokens) if kind.words else text
                out.append((given[k], len(tokens), 0, 0, hashlib.sha256(kept).hexdigest(), kept))
                continue
            tokens = Tokens(text, kind.words)
            gone = covered(tokens.n, first, mask, kind.window)
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            kept = b" ".join([w for w, g in zip(tokens.list, gone.tolist()) if not g]) if kind.words else tokens.data[~gone].tobytes()
            out.append((given[k], tokens.n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _verdict_tables(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with the number of their block, what names decided, and what the method decided."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.col("text").cast("binary").alias("text"), "doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _prime(max(4 * parts + 1, size // BLOCK_BYTES))
    buckets, shards = max(4 * parts, size // BUCKET_BYTES), max(kind.shards * parts, size // BUCKET_BYTES)
    names = docs.select("id", "text").mapInArrow(_cut(kind, buckets, blocks), _ROWS)
    # known verdicts go to a bucket by their block's number
    bucket = F.pmod("number", F.lit(buckets))
    met = materialize(names.groupBy(bucket.alias("bucket")).applyInArrow(_meet(kind, blocks), _ROWS))
    by_block = docs.withColumn("number", F.pmod("id", F.lit(blocks)).cast("int"))
    asked = by_block.groupBy("number").cogroup(met.where("what = 2").groupBy("number")).applyInArrow(_fetch(kind, shards), "shard int, blob binary, texts binary")
    return by_block, met, materialize(asked.groupBy("shard").applyInArrow(_settle(kind, blocks), _ROWS))


def without_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept_sha256, kept (the text that is left) of each document."""
    by_block, met, settled = _verdict_tables(docs, kind)
    verdicts = met.where("what = 1").union(settled.where("what = 3"))
    return by_block.groupBy("number").cogroup(verdicts.groupBy("number")).applyInArrow(
        _remove(kind), "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def decided(docs: DataFrame, kind: Kind) -> dict[str, int]:
    """How many windows were found to repeat by equal names, and how many the method judged and found to repeat."""
    _, met, settled = _verdict_tables(docs, kind)

    def count(batches):
        for batch in batches:
            sums = np.zeros(3, np.int64)
            for what, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if what == 1:
                    sums[0] += int(np.bitwise_count(unpack([blob], VERDICT)[3]).sum())
                elif what == 4:
                    sums[1:] += unpack([blob], ("<i8",))[0]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], names=["named", "judged", "found"])

    rows = met.union(settled).select("what", "blob").mapInArrow(count, "named long, judged long, found long")
    return {k: v or 0 for k, v in rows.agg(*[F.sum(c).alias(c) for c in ("named", "judged", "found")]).first().asDict().items()}
