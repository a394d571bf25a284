"""Language-model scores of documents from a sharded Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting that backs off to add-one
unigrams. Its trie is too large for one machine, so tokens are dealt by their
context into buckets that fit in memory: a bucket's task counts the training
tokens it got, builds its part of the trie, memory-maps it, and answers all the
tokens it got by successor search within their contexts. Since every word is the
context of the token after it, a bucket also knows the unigram counts of its
words. Bigrams without a training example, which only held-out texts have, go on
to the bucket of their second word for the unigram count. Sums come back by
document in packed records, one for each chunk of documents and task; unseen
bigrams travel in one record for each task and bucket.

A context that would overfill a bucket is dealt by context and word. Which ones
these are and their exact counts are found in a pass before; the buckets that hold
a part of such a context send how many different successors they have to the
bucket where the context is a word, and it adds the backoff of the unseen tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, cut, text_bytes, tidy, tidy_group
from .trie import WORD_BITS, NGramTrie
from .words import U, all_words, grouped, mix, pieces

DISCOUNT = 0.75
START, END = U(2), U(1)
CHUNK_BYTES = 6 << 20
#: Unseen tokens that a task gathers before it sends them on.
LOST_TOKENS = 2_000_000
WORD_MASK = U((1 << WORD_BITS) - 1)
#: kind 0: tokens for a bucket; 1: a chunk's documents; 2: sums for a chunk; 3: unseen tokens; 4: unigram counts; 5: totals;
#: 6: contexts of unseen tokens that were dealt by word; 7: successors of such contexts in a bucket.
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in "abcdef")])
_ROW = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"


def _z(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) if len(x) else b""


def _un(b: bytes, dtype) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _raw(b: bytes | None, dtype) -> np.ndarray:
    return np.frombuffer(b, dtype) if b else np.zeros(0, dtype)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in ROW.names} for r in rows], ROW)


def token_pairs(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of all tokens: the words of each text and an end token."""
    n = np.diff(bounds)
    texts = len(n)
    at = np.arange(len(hashes)) + np.repeat(np.arange(texts), n)
    ends = bounds[1:] + np.arange(texts)
    word = np.empty(len(hashes) + texts, U)
    word[at], word[ends] = hashes, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[bounds[:-1] + np.arange(texts)] = START
    return context, word, np.repeat(np.arange(texts), n + 1)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x ^ U(0x3C6EF372FE94F82A)) % U(buckets)).astype(np.int32)


@tidy
def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each context in a piece, and those of them to learn from."""
    for batch in pieces(batches, 0, CHUNK_BYTES):
        context, _, text = token_pairs(*all_words(batch.column(0), True))
        order, starts = grouped(context)
        n = np.diff(np.append(starts, len(order)))
        learn = np.add.reduceat(np.asarray(batch.column(1))[text[order]].astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([pa.array(context[order[starts]].view(np.int64)), pa.array(n), pa.array(learn)], ["u", "n", "learn"])


def _send(hot_words, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_words.value[0]
        task, number = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, 1, CHUNK_BYTES):
            chunk = (task << 24) | number
            number += 1
            ids, train = batch.column(0), np.asarray(batch.column(2))
            hashes, bounds = all_words(batch.column(1), True)
            context, word, text = token_pairs(hashes, bounds)
            count = np.diff(bounds) + 1
            valid = np.asarray(ids.is_valid())
            out = [{"bucket": int(chunk % buckets), "kind": 1, "chunk": chunk, "a": _z(np.asarray(ids.fill_null(0))), "b": _z(valid.astype(np.uint8)), "c": _z(count.astype(np.int64)), "d": _z(train.astype(np.uint8))}]
            to = _bucket(context, buckets)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
                much = hot[at] == context
                to[much] = _bucket(context[much] ^ mix(word[much]), buckets)
            order, _ = grouped(context)
            order = order[np.argsort(to[order], kind="stable")]
            to = to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
                mine = order[lo:hi]
                u = context[mine]
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                w, doc = word[mine], text[mine]
                learn = train[doc]
                out.append({
                    "bucket": int(to[lo]), "kind": 0, "chunk": chunk, "a": u[first].tobytes(), "b": _z(np.diff(np.append(first, hi - lo)).astype(np.uint32)), "c": (w & U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                    "d": ((w >> U(32)) & U(0xFF)).astype(np.uint8).tobytes(), "e": _z((doc * 2 + learn).astype(np.uint32)), "f": _z((w[~learn] >> U(WORD_BITS)).astype(np.uint32)),
                })
            yield _rows(out)

    return run


class _Sums:
    """Sums by chunk and document, packed into one row a chunk."""

    def __init__(self):
        self.parts: dict[int, list[tuple]] = {}

    def add(self, chunk: int, doc: np.ndarray, base: np.ndarray, score: np.ndarray, known: np.ndarray) -> None:
        self.parts.setdefault(chunk, []).append((doc, base, score, known))

    def rows(self) -> Iterator[dict]:
        for chunk, parts in self.parts.items():
            doc, base, score, known = (np.concatenate(x) for x in zip(*parts, strict=True))
            used, at = np.unique(doc, return_inverse=True)
            sums = lambda x: np.bincount(at, x, minlength=len(used))  # noqa: B023, E731
            yield {"bucket": 0, "kind": 2, "chunk": chunk, "a": _z(used.astype(np.uint32)), "b": sums(base).tobytes(), "c": sums(score).astype(np.float32).tobytes(), "d": _z(sums(known).astype(np.uint32))}


class _Lost:
    """What a task asks the buckets of words: (word, chunk, document) in rows of one kind."""

    def __init__(self, buckets: int, kind: int):
        self.buckets, self.kind, self.parts, self.n = buckets, kind, [], 0

    def add(self, word: np.ndarray, chunk: int, doc: np.ndarray) -> None:
        self.parts.append((word, np.full(len(word), chunk, np.int64), doc.astype(np.uint32)))
        self.n += len(word)

    def rows(self) -> Iterator[dict]:
        """One row a bucket; afterwards nothing is held."""
        if not self.n:
            return
        word, chunk, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        to = _bucket(word, self.buckets)
        order = np.lexsort((chunk, to))
        word, chunk, doc, to = word[order], chunk[order], doc[order], to[order]
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
            chunks, n = np.unique(chunk[lo:hi], return_counts=True)
            yield {"bucket": int(to[lo]), "kind": self.kind, "chunk": 0, "a": word[lo:hi].tobytes(), "b": _z(doc[lo:hi]), "c": _z(chunks), "d": _z(n)}


def _answer(rows: list[dict], hot: np.ndarray, hot_n: np.ndarray, buckets: int, sums: _Sums, lost_ones: _Lost, below: _Lost) -> Iterator[dict]:
    """One bucket: build and map its trie, score its tokens, gather unseen ones, yield the unigram counts."""
    bucket = rows[0]["bucket"]
    dicts = [_raw(r["a"], U) for r in rows]
    runs = [_un(r["b"], np.uint32) for r in rows]
    contexts = np.unique(np.concatenate(dicts))
    rank = np.concatenate([np.repeat(np.searchsorted(contexts, d), n) for d, n in zip(dicts, runs, strict=True)])
    word = np.concatenate([_raw(r["c"], np.uint32).astype(U) | (_raw(r["d"], np.uint8).astype(U) << U(32)) for r in rows])
    marked = [_un(r["e"], np.uint32) for r in rows]
    learn = np.concatenate(marked) % 2 == 1
    key = (rank.astype(U) << U(WORD_BITS)) | word
    order, starts = grouped(key)
    seen_n = np.add.reduceat(learn[order].astype(np.int64), starts)
    own = key[order[starts]]
    own_rank = (own >> U(WORD_BITS)).astype(np.int64)
    total = np.bincount(own_rank, seen_n, minlength=len(contexts))
    kinds = np.bincount(own_rank, seen_n > 0, minlength=len(contexts))
    at = np.minimum(np.searchsorted(hot, contexts), max(len(hot) - 1, 0)) if len(hot) else np.zeros(len(contexts), int)
    is_hot = hot[at] == contexts if len(hot) else np.zeros(len(contexts), bool)
    if len(hot):
        total = np.where(is_hot, hot_n[at], total)
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = np.where((total > 0) & (kinds > 0) & ~is_hot, np.log10(np.minimum(1.0, DISCOUNT * kinds / total)), 0.0)
        trained = seen_n > 0
        score = np.log10((seen_n[trained] - DISCOUNT) / total[own_rank[trained]])
    trie = NGramTrie.build(contexts, backoff, own_rank[trained], own[trained] & WORD_MASK, score).mapped()
    value, seen = trie.query(contexts, own_rank, own & WORD_MASK)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    value, seen = value[back], seen[back]
    base = np.where(contexts == START, 0.0, np.log10(total + 1.0))[rank]
    known = ((total > 0) & (contexts != START))[rank]
    lo = 0
    for r, m in zip(rows, marked, strict=True):
        hi = lo + len(m)
        doc = (m >> 1).astype(np.int64)
        sums.add(r["chunk"], doc, base[lo:hi], value[lo:hi], known[lo:hi])
        lost = np.flatnonzero(~seen[lo:hi])
        if len(lost):
            held = np.cumsum(m % 2 == 0) - 1
            w = word[lo:hi][lost] | (_un(r["f"], np.uint32).astype(U)[held[lost]] << U(WORD_BITS))
            lost_ones.add(w, r["chunk"], doc[lost])
            spread = rank[lo:hi][lost]
            spread_at = np.flatnonzero(is_hot[spread] & (total[spread] > 0))
            if len(spread_at):
                below.add(contexts[spread[spread_at]], r["chunk"], doc[lost[spread_at]])
        lo = hi
    part = np.flatnonzero(is_hot & (kinds > 0))
    to = _bucket(contexts[part], buckets)
    for b in np.unique(to):
        mine = part[to == b]
        yield {"bucket": int(b), "kind": 7, "chunk": 0, "a": contexts[mine].tobytes(), "b": _z(kinds[mine].astype(np.int64))}
    keep = (total > 0) & ~is_hot & (contexts != START)
    yield {"bucket": bucket, "kind": 4, "chunk": 0, "a": contexts[keep].tobytes(), "b": _z(total[keep].astype(np.int64))}


def _first(hot_words, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n = hot_words.value
        sums, asked, held = _Sums(), (_Lost(buckets, 3), _Lost(buckets, 6)), []

        def close() -> Iterator[pa.RecordBatch]:
            yield _rows(list(_answer(held, hot, hot_n, buckets, sums, *asked)))
            held.clear()
            for x in asked:
                if x.n >= LOST_TOKENS:
                    yield _rows(list(x.rows()))

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    yield _rows([row])
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from close()
                held.append(row)
        if held:
            yield from close()
        for x in asked:
            if x.n:
                yield _rows(list(x.rows()))
        for row in sums.rows():
            yield _rows([row])

    return run


def _second(hot_words, buckets: int):
    """Unigram counts of unseen tokens' words; everything else passes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_n = hot_words.value
        sums, held = _Sums(), []

        def each(r: dict) -> Iterator[tuple[int, slice]]:
            upto = 0
            for chunk, count in zip(_un(r["c"], np.int64).tolist(), _un(r["d"], np.int64).tolist(), strict=True):
                yield chunk, slice(upto, upto + count)
                upto += count

        def close() -> Iterator[pa.RecordBatch]:
            tables = [r for r in held if r["kind"] == 4]
            words = np.concatenate([_raw(r["a"], U) for r in tables] + [hot])
            n = np.concatenate([_un(r["b"], np.int64) for r in tables] + [hot_n])
            order = np.argsort(words)
            words, n = words[order], n[order]
            for r in held:
                if r["kind"] == 3:
                    w, doc = _raw(r["a"], U), _un(r["b"], np.uint32).astype(np.int64)
                    at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
                    c = np.where(words[at] == w, n[at], 0) if len(words) else np.zeros(len(w))
                    value, end = np.log10(c + 1.0) * (w != END), (w == END).astype(float)
                    for chunk, own in each(r):
                        zero = np.zeros(own.stop - own.start)
                        sums.add(chunk, doc[own] * 2, zero, value[own], zero)
                        sums.add(chunk, doc[own] * 2 + 1, zero, end[own], zero + 1)
            shares = [r for r in held if r["kind"] == 7]
            if shares:
                u, which = np.unique(np.concatenate([_raw(r["a"], U) for r in shares]), return_inverse=True)
                followers = np.bincount(which, np.concatenate([_un(r["b"], np.int64) for r in shares]))
                weight = np.log10(np.minimum(1.0, DISCOUNT * followers / hot_n[np.searchsorted(hot, u)]))
                for r in held:
                    if r["kind"] == 6:
                        value, doc = weight[np.searchsorted(u, _raw(r["a"], U))], _un(r["b"], np.uint32).astype(np.int64)
                        for chunk, own in each(r):
                            zero = np.zeros(own.stop - own.start)
                            sums.add(chunk, doc[own] * 2, zero, value[own], zero)
            kinds = sum(len(_raw(r["a"], U)) for r in tables)
            held.clear()
            yield _rows([{"bucket": 0, "kind": 5, "chunk": -1, "a": np.array([kinds], np.int64).tobytes()}])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] in (1, 2):
                    yield _rows([row])
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from close()
                held.append(row)
        if held:
            yield from close()
        for row in sums.rows():
            yield _rows([{**row, "kind": 3}])

    return run


_DOC = "id long, train boolean, n_tokens long, n_known long, base double, score double, unseen long, unseen_ends long, kinds long"


@tidy_group
def _finish(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    heads = [r for r in rows if r["kind"] == 1]
    if not heads:
        kinds = sum(int(_raw(r["a"], np.int64)[0]) for r in rows)
        return pa.table({"id": pa.array([None], pa.int64()), "train": pa.array([None], pa.bool_()), **{c: pa.array([0], pa.int64()) for c in ("n_tokens", "n_known")}, "base": [0.0], "score": [0.0], "unseen": pa.array([0], pa.int64()), "unseen_ends": pa.array([0], pa.int64()), "kinds": pa.array([kinds], pa.int64())}).select([c.split()[0] for c in _DOC.split(", ")])
    head = heads[0]
    n = _un(head["c"], np.int64)
    base, score, known, unseen, ends = (np.zeros(len(n)) for _ in range(5))
    for r in rows:
        if r["kind"] == 1:
            continue
        doc, b, s, k = _un(r["a"], np.uint32), _raw(r["b"], np.float64), _raw(r["c"], np.float32), _un(r["d"], np.uint32)
        if r["kind"] == 2:
            base[doc] += b
            score[doc] += s
            known[doc] += k
        else:
            odd = doc % 2 == 1
            score[doc[~odd] // 2] += s[~odd]
            ends[doc[odd] // 2] += s[odd]
            unseen[doc[odd] // 2] += k[odd]
    ids = pa.array(_un(head["a"], np.int64), mask=_un(head["b"], np.uint8) == 0)
    return pa.table({"id": ids, "train": pa.array(_un(head["d"], np.uint8) == 1), "n_tokens": pa.array(n), "n_known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(score), "unseen": pa.array(unseen.astype(np.int64)), "unseen_ends": pa.array(ends.astype(np.int64)), "kinds": pa.array(np.full(len(n), -1))})


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = 1_500_000, hot_tokens: int | None = None) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) by row; scores are log10 of text probabilities.

    The model learns from the rows for which ``train`` holds (null: not) and
    scores all. Words are lower-cased in A-Z; every text ends with an end token,
    so null and empty texts have one token. base_score is the add-one unigram
    model's. Without training rows every token has the unigram probability 1 / 1.
    Rows that share an id are scored each on their own; null ids come back null.
    Contexts with ``hot_tokens`` tokens or more, a quarter of a bucket unless
    given, are split. Other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    count, size = text_bytes(docs, text_col)
    buckets = max(4, (size // 6 + count) // bucket_tokens + 1)
    least = hot_tokens or bucket_tokens // 4
    often = rows.select("text", "train").mapInArrow(_frequent, "u long, n long, learn long").groupBy("u").agg(F.sum("n").alias("n"), F.sum("learn").alias("learn")).where(F.col("n") >= least)
    found = sorted((int(np.int64(r["u"]).view(U)), r["learn"]) for r in often.collect())
    hot, hot_n = np.array([u for u, _ in found], U), np.array([n for _, n in found], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_n))
    dealt = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    sent = rows.mapInArrow(_send(shared, buckets), _ROW)
    answered = dealt(sent).mapInArrow(_first(shared, buckets), _ROW)
    spread = answered.withColumn("bucket", F.when(F.col("kind").isin(3, 4, 6, 7), F.col("bucket")).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(buckets)).cast("int")))
    settled = dealt(spread).mapInArrow(_second(shared, buckets), _ROW)
    by_doc = cut(settled.groupBy("chunk").applyInArrow(_finish, _DOC))
    totals = by_doc.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("tokens"), F.count_if("train").alias("texts"), F.sum(F.when(F.col("kinds") > 0, F.col("kinds"))).alias("kinds")).first()
    learned, texts = totals["tokens"] or 0, totals["texts"] or 0
    kinds = (totals["kinds"] or 0) + int(((hot_n > 0) & (hot != START)).sum()) + (texts > 0)
    per = math.log10(learned + kinds + 1)
    end = math.log10(texts + 1)
    out = by_doc.where("kinds = -1")
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", (F.col("n_known") + (1 if texts else 0)).alias("n_known"), F.lit(learned).cast("long").alias("train_tokens"), (F.col("base") + end - F.col("n_tokens") * per).alias("base_score"), (F.col("score") + F.col("unseen_ends") * end - F.col("unseen") * per).alias("score"))
