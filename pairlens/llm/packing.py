"""Sum-of-squares packing of tokenised documents into sequences.

Documents become token ids and one end id; what is longer than a sequence is cut
from its end into full pieces, so that only a first piece can be shorter. Pieces
are dealt by hash into groups of a bounded number of pieces, and each group is packed by
the sum-of-squares rule: a piece goes where the sum over gaps of the squared
number of open sequences with that gap becomes smallest. Pieces are taken in
falling length. A group wastes a bounded number of part-filled sequences, so the
share of waste falls with the size of groups, not with that of the corpus.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, text_bytes, tidy, tidy_group

#: The one added token of the vocabulary.
END_OF_TEXT = "<|endoftext|>"
_encoders: dict[str, object] = {}


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """Encoder from a file of merge ranks, kept by worker; the end-of-text mark in a text is the id after the ranks."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return _encoders[path]


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first can be shorter than ``length``."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))] if n else []


def _pieces(path: str, length: int, end_id: int, digest: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        count = 0

        def encode(t: str) -> list[int]:
            return own.encode(t, allowed_special="all") if END_OF_TEXT in t else own.encode_ordinary(t)

        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            salts = np.where(np.asarray(ids.is_valid()), 0, count + np.arange(batch.num_rows))
            count += batch.num_rows
            for lo in range(0, batch.num_rows, 512):
                row, piece, start, size, last = [], [], [], [], []
                for i, t in enumerate(text.slice(lo, 512).to_pylist(), lo):
                    tokens = np.array(encode(t) + [end_id] if t else [end_id], "<u4")
                    for k, (s, n) in enumerate(cuts(len(tokens), length)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        size.append(n)
                        last.append(zlib.crc32(tokens[s : s + n].tobytes()) if digest else tokens[s : s + n])
                out = pa.array(last, pa.int64() if digest else pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), out, pa.array(salts[row], pa.int64())], ["id", "piece", "start", "length", "ids_crc32" if digest else "ids", "salt"])

    return run


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, number of sequences) for pieces of 1..length tokens, taken in falling size.

    A piece of size s that goes into a sequence with gap g changes the sum of
    squares by 1 - 2 N(g), if it is open already, plus 2 N(g - s) + 1, if it
    stays open. Ties go to the fuller sequence.
    """
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    count = np.zeros(length + 1, np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        cost = np.where(count[s:] > 0, 1 - 2 * count[s:], 4 * len(sizes) + 4)
        cost[-1] = 0
        cost[1:] += 2 * count[1 : length - s + 1] + 1
        g = s + int(np.argmin(cost))
        if g == length:
            b, made = made, made + 1
        else:
            b = open_[g].pop()
            count[g] -= 1
        sequence[i], offset[i] = b, length - g
        if g > s:
            open_[g - s].append(b)
            count[g - s] += 1
    return sequence, offset, made


def _packer(length: int):
    @tidy_group
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["group"]).sort_by([("id", "ascending"), ("salt", "ascending"), ("piece", "ascending")]).drop_columns(["salt"])
        sequence, offset, _ = sum_of_squares(rows.column("length").to_numpy(), length)
        return rows.append_column("sequence_id", pa.array(sequence + (int(key[0].as_py()) << 32))).append_column("offset", pa.array(offset))

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, vocabulary: str | None = None, group_pieces: int = 40_000, digest: bool = False) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): one row for each piece of each row.

    ``vocabulary`` is a merge-rank file, byte_bpe_50k.tiktoken unless given, whose
    ids are those of byte_bpe_50k.json; an end-of-text mark in a text is its own
    token, as there. Null and empty texts are the end id alone. Null ids come back
    null and are spread over the groups, as are long texts, piece by piece. Rows
    that share an id are packed each on their own. An empty table gives no rows.
    Offsets in a sequence have no gaps; sequence ids are unique but not dense.
    With ``digest`` ids_crc32, over little-endian 32-bit ids, stands for ids.
    Other columns are ignored, whatever their names.
    """
    path = vocabulary or tokenizer_file("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    last = "ids_crc32 long" if digest else "ids array<int>"
    shape = f"id long, piece int, start long, length long, {last}"
    bound_batches(docs.sparkSession)
    n, size = text_bytes(rows, "text")
    groups = max(1, -(-(n + size // length) // group_pieces))
    cut = rows.mapInArrow(_pieces(path, length, end_id, digest), f"{shape}, salt long")
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("id", "piece", "salt"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("group").applyInArrow(_packer(length), f"{shape}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
