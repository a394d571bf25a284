"""Substring dedup by prefix-partitioned suffix trees.

Suffixes start at every word, and a run of ``min_words`` words that stands in two
documents is a node of the suffix tree, that deep at least, with leaves in both.

1. A counting pass sizes the groups of suffixes that share their first 1, 2, 4 or 8
   words (hashed to a fixed number of slots). A group that would not fit in memory
   is split by a longer prefix, and groups are packed into buckets.
2. Rows are dealt into parts by a hash. Each part sends truncated fingerprints of
   its windows of ``min_words`` words; those that stand in one part only are leaves
   right below the root path of no deep node, and are pruned. Chance agreements only
   keep a suffix that could have gone.
3. Each part sorts the suffixes that are left by their symbols, takes its own deep
   nodes, and sends the suffixes of the smallest id of each node to their groups. A
   suffix goes as a string of at most SYMBOLS symbols: blocks of consecutive words,
   each by a 32-bit name, or the words themselves where ``min_words`` is no more.
4. A bucket sorts its suffixes, computes the longest common prefix of neighbours,
   and finds the intervals that share all symbols: the internal nodes of depth
   ``min_words``. Leaves with an id above a node's smallest are marked.
5. Parts remove the words under marks; neighbouring marks join into maximal repeats.

A passage that stands in a third of all documents leaves each part once.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, text_bytes, tidy, tidy_cogroup, tidy_group
from .words import Runs, U, Words, all_words, blocks, run_starts

LEVELS = (1, 2, 4, 8)
#: Bytes of texts that are worked on together; the arrays take about 20 times as much.
PART_BYTES = 6 << 20
#: Windows of one bucket of fingerprints.
BUCKET_PRINTS = 2_500_000
#: Symbols of a suffix at most.
SYMBOLS = 4
PRINTS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
SHARED = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("ranks", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("docs", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "windows", "symbols"))])
MARKS = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("windows", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _rows(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _slots(runs: Runs, at: np.ndarray, level: int, length: int, slots: int) -> np.ndarray:
    return (runs.at(at, min(level, length)) >> U(13)).astype(np.int64) & (slots - 1)


def _counter(length: int, slots: int):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LEVELS), slots), np.int64)
        for batch in batches:
            for _, _, w in blocks(batch.column(0), False):
                at = run_starts(w.bounds, length)
                if len(at):
                    runs = Runs(w.hashes)
                    for k, level in enumerate(LEVELS):
                        total[k] += np.bincount(_slots(runs, at, level, length, slots), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.reshape(-1)[at])], ["slot", "n"])

    return count


def plan_groups(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each (level, slot): -1 where the group needs a longer prefix.

    A group stays at the shortest prefix at which it is at most a quarter of a
    bucket; groups go, largest first, to the bucket that is emptiest. What is too
    large at the longest prefix as well is spread by the hash of whole windows.
    """
    cap = max(1, int(counts[0].sum()) // (4 * buckets))
    to = np.full(counts.shape, -1, np.int32)
    level, slot = np.nonzero(counts <= cap)
    sizes = counts[level, slot] / 4.0 ** level
    heap = [(0.0, b) for b in range(buckets)]
    for i in np.argsort(-sizes, kind="stable"):
        full, b = heapq.heappop(heap)
        to[level[i], slot[i]] = b
        heapq.heappush(heap, (full + sizes[i], b))
    return to


def _route(runs: Runs, at: np.ndarray, length: int, to: np.ndarray, buckets: int) -> np.ndarray:
    slots = to.shape[1]
    out = np.full(len(at), -1, np.int32)
    todo = np.arange(len(at))
    for k, level in enumerate(LEVELS):
        out[todo] = to[k][_slots(runs, at[todo], level, length, slots)]
        todo = todo[out[todo] < 0]
        if not len(todo):
            return out
    out[todo] = (runs.at(at[todo], length) >> U(40)).astype(np.int64) % buckets
    return out


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(buf: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(buf, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def _rising(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=0).astype(np.uint32))


def _unrising(buf: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(buf, np.uint32, n), dtype=np.int64)


def symbol_count(length: int) -> int:
    """Symbols of a window of so many words."""
    return -(-length // -(-length // SYMBOLS))


class _Part:
    """The texts of a part in the order of (id, key), and their windows."""

    def __init__(self, docs: pa.Table, length: int):
        ids, keys = docs.column("id").to_numpy(), docs.column("key").to_numpy()
        self.order = np.lexsort((keys, ids))
        self.ids, self.length = ids[self.order], length
        self.text = docs.column("text").combine_chunks()
        self.text = (pa.concat_arrays(self.text.chunks) if isinstance(self.text, pa.ChunkedArray) else self.text).take(pa.array(self.order))

    def windows(self) -> tuple[Runs, np.ndarray, np.ndarray]:
        """(runs, starts of the windows, their documents)."""
        self.hashes, bounds = all_words(self.text, False)
        at = run_starts(bounds, self.length)
        n = np.maximum(np.diff(bounds) - self.length + 1, 0)
        return Runs(self.hashes), at, np.repeat(np.arange(len(n)), n)

    def symbols(self, runs: Runs, at: np.ndarray) -> np.ndarray:
        """(windows, symbols): blocks of words that cover each window, the last flush with its end."""
        block = -(-self.length // SYMBOLS)
        offsets = np.minimum(np.arange(symbol_count(self.length)) * block, self.length - block)
        if block == 1:
            return (self.hashes[at[:, None] + offsets] >> U(32)).astype(np.uint32)
        return np.stack([(runs.at(at + o, block) >> U(32)).astype(np.uint32) for o in offsets], 1)


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows in the order of their symbols, equal ones in rising position, and how many symbols each shares with the one before."""
    n, width = symbols.shape
    order = np.arange(n)
    open_ = np.array([[0, n]]) if n > 1 else np.zeros((0, 2), np.int64)
    for k in range(0, width, 2):
        if not len(open_):
            break
        size = open_[:, 1] - open_[:, 0]
        at = np.repeat(open_[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        rows = order[at]
        key = symbols[rows, k].astype(U) << U(32)
        if k + 1 < width:
            key |= symbols[rows, k + 1]
        group = np.repeat(np.arange(len(size)), size)
        sort = np.lexsort((key, group)) if len(size) > 1 else np.argsort(key, kind="stable")
        order[at] = rows[sort]
        key, start = key[sort], np.concatenate([[True], group[1:] != group[:-1]])
        start[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(start)
        stop = np.append(first[1:], len(at))
        many = stop - first > 1
        open_ = np.stack([at[first[many]], at[stop[many] - 1] + 1], 1)
    lcp = np.zeros(n, np.int64)
    alike = np.ones(max(n - 1, 0), bool)
    for k in range(width):
        alike = alike & (symbols[order[1:], k] == symbols[order[:-1], k])
        lcp[1:] += alike
    return order, lcp


def deep_leaves(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id among the leaves below each row's node of full depth; a leaf with no such node has its own."""
    order, lcp = suffix_order(symbols)
    least = np.empty(len(order), np.int64)
    if len(order):
        starts = np.flatnonzero(lcp < symbols.shape[1])
        least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(order))))
    return least


def _prints(part: _Part, bits: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    runs, at, doc = part.windows()
    return runs, at, doc, runs.at(at, part.length) >> U(32 - bits)


def _printer(length: int, bits: int):
    """Distinct fingerprints of a part's windows: 32 bits each, beyond those that number the bucket."""

    @tidy_group
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = np.unique(_prints(_Part(docs, length), bits)[3])
        bucket = (found >> U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(found))[: len(cuts)], strict=True):
            step = np.diff((found[lo:hi] & U(0xFFFFFFFF)).astype(np.int64), prepend=0).astype(np.uint32)
            out.append([int(bucket[lo]), key[0].as_py(), int(lo), int(hi - lo), step.astype(np.uint16).tobytes(), _packed((step >> 16).astype(np.uint16))])
        return _rows(out, PRINTS)

    return run


@tidy
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket at a time: the ranks of each part's fingerprints that another part has too."""
    held: list[dict] = []

    def close() -> Iterator[pa.RecordBatch]:
        n = np.array([r["n"] for r in held])
        values = np.concatenate([np.cumsum(np.frombuffer(r["low"], np.uint16).astype(np.int64) | (_unpacked(r["high"], np.uint16, r["n"]).astype(np.int64) << 16)) for r in held])
        rank = np.argsort(values, kind="stable")
        same = values[rank[1:]] == values[rank[:-1]]
        twice = np.zeros(len(values), bool)
        twice[rank[1:][same]] = twice[rank[:-1][same]] = True
        out = []
        for r, lo, hi in zip(held, np.cumsum(n) - n, np.cumsum(n), strict=True):
            at = np.flatnonzero(twice[lo:hi]) + r["first"]
            if len(at):
                out.append([r["part"], len(at), _rising(at)])
        held.clear()
        yield from _rows(out, SHARED).to_batches()

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from close()
            held.append(row)
    if held:
        yield from close()


def _sender(length: int, bits: int, to, buckets: int):
    """Suffixes of a part for buckets, and with bucket -1 - part the part's own marks."""

    @tidy_cogroup
    def send(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        part, number = _Part(docs, length), key[0].as_py()
        runs, at, doc, prints = _prints(part, bits)
        distinct, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
        keep = count > 1
        for row in shared.to_pylist():
            keep[_unrising(row["ranks"], row["n"])] = True
        chosen = np.flatnonzero(keep[inverse])
        del distinct, inverse, count, prints
        if not len(chosen):
            return _rows([], SENT)
        ids = part.ids[doc[chosen]]
        symbols = part.symbols(runs, at[chosen])
        least = deep_leaves(symbols, ids)
        out = []
        known = chosen[ids > least]
        if len(known):
            out.append([-1 - number, number, len(known), 0, b"", b"", _rising(known), b""])
        rest = np.flatnonzero(ids == least)
        bucket = _route(runs, at[chosen[rest]], length, to.value, buckets)
        sort = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[sort], prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(sort))[: len(cuts)], strict=True):
            mine = rest[sort[lo:hi]]
            d, n = np.unique(doc[chosen[mine]], return_counts=True)
            out.append([int(bucket[sort[lo]]), number, len(mine), len(d), part.ids[d].tobytes(), _packed(n.astype(np.uint32)), _rising(chosen[mine]), _packed(symbols[mine].T)])
        return _rows(out, SENT)

    return send


def _settle(width: int):
    """One bucket at a time: sort its suffixes, find its deep nodes, mark the leaves that a smaller id shares. A part's own marks pass."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), _unpacked(r["counts"], np.uint32, r["docs"])) for r in held])
            symbols = np.concatenate([_unpacked(r["symbols"], np.uint32, r["n"] * width).reshape(width, -1).T for r in held])
            hit, upto, out = ids > deep_leaves(symbols, ids), 0, []
            for r in held:
                at = np.flatnonzero(hit[upto : upto + r["n"]])
                upto += r["n"]
                if len(at):
                    out.append([r["part"], len(at), _rising(_unrising(r["windows"], r["n"])[at])])
            held.clear()
            yield from _rows(out, MARKS).to_batches()

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield from _rows([[row["part"], row["n"], row["windows"]]], MARKS).to_batches()
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from close()
                held.append(row)
        if held:
            yield from close()

    return run


def _cleaner(length: int, text_too: bool):
    """The rows of a part without the words under marks."""

    @tidy_cogroup
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        part = _Part(docs, length)
        found = [_unrising(r["windows"], r["n"]) for r in marks.to_pylist()]
        gone_at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n_words, n_removed, kept, upto = [], [], [], 0
        for lo, _, w in blocks(part.text, False):
            at = run_starts(w.bounds, length)
            first, last = np.searchsorted(gone_at, (upto, upto + len(at)))
            starts = at[gone_at[first:last] - upto]
            upto += len(at)
            gone = np.bincount(starts, minlength=len(w.hashes) + 1).astype(np.int32) - np.bincount(starts + length, minlength=len(w.hashes) + 1)
            keep = np.cumsum(gone[:-1]) == 0
            out, cut = joined_words(w, keep)
            n = np.diff(w.bounds)
            left = np.concatenate([[0], np.cumsum(keep)])
            left = left[w.bounds[1:]] - left[w.bounds[:-1]]
            n_words += n.tolist()
            n_removed += (n - left).tolist()
            for i in range(len(n)):
                s = out[cut[i] : cut[i + 1]]
                if left[i] and s[-1:] == b" ":
                    s = s[:-1]
                if not text_too:
                    kept.append(hashlib.sha256(s).hexdigest())
                else:
                    kept.append(s.decode() if left[i] < n[i] else part.text[lo + i].as_py())
        columns = {"record": docs.column("record").take(pa.array(part.order)), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table(columns | {"kept_text" if text_too else "kept_sha256": pa.array(kept, pa.string())})

    return run


def joined_words(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of a block, each but a text's last byte with one space after it, and the bounds of texts in them."""
    data = w.data.copy()
    stop = np.repeat(w.offsets[1:], np.diff(w.bounds))[keep]
    starts, ends = w.starts[keep], w.ends[keep]
    tail = np.minimum(ends + 1, stop)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[tail] -= 1
    data[ends[ends < stop]] = 0x20
    length = np.concatenate([[0], np.cumsum(tail - starts)])
    upto = np.concatenate([[0], np.cumsum(keep)])
    return data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes(), length[upto[w.bounds]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, digest: bool = False, bucket_words: int = 4_000_000, carry: bool = False) -> DataFrame:
    """Remove the words of every run of ``min_words`` words that starts in a document with a smaller id too.

    Returns (id, n_words, n_removed, kept_text), or kept_sha256 for kept_text
    with ``digest``; one row for each input row, none for an empty table. Kept
    words are joined by one space; a kept_text from which nothing goes is the text
    as it was. Runs are judged on the input: what is removed from one document does
    not save another. Null and empty texts have no words and stay as they are; a
    text of any length is worked on whole. A null id ranks as the largest long and
    comes back null. Rows that share an id are not each other's source, so repeated
    rows keep their words. Other columns are ignored, whatever their names; with
    ``carry`` they come back, with the id but without the text, in a struct
    ``record`` in place of the id.

    Fingerprints that prune have 32 bits beyond their bucket's number and decide
    nothing else. Suffixes are ordered and compared by all their symbols, of 32 bits
    each; runs of one or two words would have too few of them and are refused.
    """
    if min_words < 3:
        raise ValueError("min_words must be at least 3")
    spark = docs.sparkSession
    bound_batches(spark)
    n, size = text_bytes(docs, text_col)
    parts = max(16, size // PART_BYTES + n // 100_000 + 1)
    buckets = max(4, size // 6 // bucket_words + 1) * 2
    bits = max(2, (size // 6 // BUCKET_PRINTS).bit_length())
    text = F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    atomic = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    record = F.struct(*rest) if carry else F.col(f"`{id_col}`")
    given = docs.select(record.alias("record"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.pmod(F.xxhash64(F.lit(23), *atomic), F.lit(parts)).cast("int").alias("part"))

    slots = 1 << min(17, max(10, int(buckets * 8).bit_length()))
    counts = np.zeros(len(LEVELS) * slots, np.int64)
    for r in docs.select(text.alias("text")).mapInArrow(_counter(min_words, slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["slot"]] = r["n"]
    to = spark.sparkContext.broadcast(plan_groups(counts.reshape(len(LEVELS), slots), buckets))

    dealt = given.groupBy("part")
    prints = dealt.applyInArrow(_printer(min_words, bits), _ddl(PRINTS))
    shared = prints.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _ddl(SHARED))
    sent = dealt.cogroup(shared.groupBy("part")).applyInArrow(_sender(min_words, bits, to, buckets), _ddl(SENT))
    marks = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(symbol_count(min_words)), _ddl(MARKS))
    new = "kept_sha256" if digest else "kept_text"
    out = dealt.cogroup(marks.groupBy("part")).applyInArrow(_cleaner(min_words, not digest), given.select("record").schema.add("n_words", "long").add("n_removed", "long").add(new, "string"))
    return out if carry else out.withColumnRenamed("record", id_col)
