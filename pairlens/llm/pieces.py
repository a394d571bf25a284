"""SentencePiece encoding that keeps, for every piece, its byte span in the source; and decoding.

A model file holds a compiled character map: a double-array trie of source
strings, each with its replacement. Normalisation walks a text, takes the longest
rule that starts where it stands (one character as it is where none does), and
records for every byte it writes where in the source that came from. Spaces become
the escape mark and a mark is put before the text, as the model says. Pieces tile
the normalised text, so the running sum of their lengths, looked up in that record,
is the span of each in the source. The library segments; it is handed the text
already normalised, so that what is recorded is what is encoded.

No piece of a byte-fallback BPE model without inner marks reaches over the start of
a word, so words are segmented one by one and kept, and a long text is read in
blocks cut before words. Other models are given whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import tokenizer_file
from .session import bound_batches, tidy

MARK = "▁"
#: Characters of a block, bytes of text of an output batch, characters of a word that is kept, words that are kept.
BLOCK, BATCH, LONGEST, KEPT = 1 << 16, 1 << 18, 48, 300_000
#: Types of pieces in a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
_models: dict[str, Model] = {}


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix rules of a compiled map: its trie's units, then replacements that end in a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
        self.targets = compiled[4 + size :]
        self.rules = {key.decode(): self.target(value) for key, value in self._keys()}
        if any("  " in t for t in self.rules.values()):
            raise ValueError("a rule writes two spaces in a row")
        single = [k for k in self.rules if len(k) == 1]
        several = [k for k in self.rules if len(k) > 1]
        self.longest = max(map(len, self.rules), default=0)
        self.inner_space = any(" " in k[1:] for k in several)
        of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        tries = ([of(single)] if single else []) + ([f"{of({k[0] for k in several})}(?={of({k[1] for k in several})})"] if several else [])
        #: Where a rule may start.
        self.starts = "|".join(tries)

    def target(self, at: int) -> str:
        return self.targets[at : self.targets.index(b"\0", at)].decode()

    def _keys(self) -> Iterator[tuple[bytes, int]]:
        """All keys of the trie, a level at a time. A unit holds a label, whether a value follows, and the way to its children."""
        units, labels = self.units, np.arange(256, dtype=np.uint32)

        def down(unit: np.ndarray) -> np.ndarray:
            return (unit >> 10) << ((unit & 512) >> 6)

        at, keys = down(units[:1]), [b""]
        while keys:
            to = at[:, None] ^ labels
            found = to < len(units)
            found[:, 0] = False
            found &= (units[np.where(found, to, 0)] & np.uint32(0x800000FF)) == labels
            row, label = np.nonzero(found)
            unit = units[to[row, label]]
            keys = [keys[r] + bytes([c]) for r, c in zip(row.tolist(), label.tolist(), strict=True)]
            at = to[row, label] ^ down(unit)
            for i in np.flatnonzero(unit & 256).tolist():
                yield keys[i], int(units[at[i]] & 0x7FFFFFFF)

    def match(self, text: str, at: int) -> tuple[int, str] | None:
        """(characters, replacement) of the longest rule that starts at a position."""
        for n in range(min(self.longest, len(text) - at), 0, -1):
            if (key := text[at : at + n]) in self.rules:
                return n, self.rules[key]
        return None


class Normaliser:
    """What a model's normalizer section asks for, with the source of every byte written."""

    def __init__(self, spec: bytes, suffix: bool, user_defined: list[str]):
        said = dict(fields(spec))
        self.map = CharacterMap(said[2]) if said.get(2) else None
        self.prefix, self.extra, escape = (bool(said.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.space = MARK if escape else " "
        self.own = re.compile("|".join(map(re.escape, sorted(user_defined, key=len, reverse=True)))) if user_defined else None
        tries = [self.own.pattern] if self.own else []
        if self.map and self.map.starts:
            tries.append(self.map.starts)
        self.starts = re.compile("|".join(tries)) if tries else None
        spaces = {k[-1] for k, to in self.map.rules.items() if not to or to.endswith(" ")} if self.map else set()
        #: A space after what does not end in a space or vanish: a text can be cut there.
        self.word = re.compile(rf"(?<=[^\s{MARK}{''.join(map(re.escape, sorted(spaces)))}]) ")

    @property
    def by_blocks(self) -> bool:
        return not self.extra and not self.suffix and self.own is None and not (self.map and self.map.inner_space)

    def rewrites(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(position, characters, replacement) in order of position, without overlaps."""
        done = 0
        while self.starts and (m := self.starts.search(text, done)):
            at = m.start()
            if self.own and (kept := self.own.match(text, at)):
                n, to = len(kept[0]), kept[0]
            else:
                n, to = (self.map.match(text, at) if self.map else None) or (1, None)
            if to is not None:
                yield at, n, to
            done = at + n

    def heading(self, text: str) -> int:
        """Characters before the first that is not, or does not become, one space."""
        at = 0
        while at < len(text):
            n, to = (self.map.match(text, at) if self.map else None) or (1, text[at])
            if to != " ":
                break
            at += n
        return at

    def plain(self, text: str) -> tuple[bytes, np.ndarray]:
        """Text after the rules, and the source byte of each of its bytes; spaces are still as they were."""
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        source = np.repeat(starts, np.diff(starts, append=len(data)))
        out, at, done = [], [], 0
        byte = lambda i: int(starts[i]) if i < len(starts) else len(data)
        for i, n, to in self.rewrites(text):
            lo = byte(i)
            new = to.encode()
            out += [data[done:lo].tobytes(), new]
            at += [source[done:lo], np.full(len(new), lo, np.int64)]
            done = byte(i + n)
        return b"".join([*out, data[done:].tobytes()]), np.concatenate([*at, source[done:]])

    def __call__(self, text: str, first: bool = True) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each of its bytes, then that of its end). ``first``: the text starts here."""
        size = len(text.encode())
        head = self.heading(text) if self.extra else 0
        if head == len(text):
            return "", np.array([size])
        skipped = len(text[:head].encode())
        written, source = self.plain(text[head:])
        source = source + skipped
        data = np.frombuffer(written, np.uint8)
        space = data == 0x20
        if self.extra:
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            data, source, space = data[keep], source[keep], space[keep]
        width = np.where(space, len(self.space.encode()), 1)
        body = data.tobytes().decode().replace(" ", self.space)
        source = np.repeat(source, width)
        add = self.space if self.prefix else ""
        if first and add and not self.suffix:
            body, source = add + body, np.concatenate([np.full(len(add.encode()), skipped), source])
        end = size
        if self.extra and body.endswith(self.space):
            body = body.rstrip(self.space)
            cut = len(body.encode())
            end = int(source[cut])
            source = source[:cut]
        if add and self.suffix:
            body, source = body + add, np.concatenate([source, np.full(len(add.encode()), end)])
        return body, np.append(source, end)


class Model:
    """A model file: its normaliser, the length of each piece, and the library for texts that are normalised already."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        pieces, trainer, spec = [], {}, b""
        for number, value in fields(raw):
            if number == 1:
                pieces.append({k: v for k, v in fields(value)})
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                spec += value
        kinds = np.array([p.get(3, 1) for p in pieces])
        names = [p[1].decode() for p in pieces]
        self.normalise = Normaliser(spec, bool(trainer.get(24, 0)), [n for n, k in zip(names, kinds, strict=True) if k == USER_DEFINED])
        self.lengths = np.where(kinds == BYTE, 1, [len(n.encode()) for n in names])
        fallback = bool(trainer.get(35, 0))
        self.by_words = self.normalise.by_blocks and fallback and trainer.get(3, 1) == 2 and not any(re.search(f"[^{MARK}]{MARK}", n) for n in names)
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        own = b"\x12\x00\x18\x00\x20\x00\x28\x00"  # an empty map, no mark before, all spaces, no escapes: fields that come later hold
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a" + bytes([len(own)]) + own)
        self.exact_lengths = fallback
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        #: Ids of words: the first that come, so the frequent ones.
        self.kept: dict[str, bytes] = {}

    def words(self, text: str) -> np.ndarray:
        """Ids of a normalised text, a word at a time."""
        found = self.split(text)
        kept = self.kept
        got = [kept.get(w) for w in found]
        if None in got:
            new = [w for w, ids in zip(found, got, strict=True) if ids is None]
            made = [array("I", ids).tobytes() for ids in self.segment.encode(new, num_threads=1)]
            room = KEPT - len(kept)
            kept.update((w, ids) for w, ids in zip(new[: max(0, room)], made, strict=False) if len(w) <= LONGEST)
            rest = iter(made)
            got = [next(rest) if ids is None else ids for ids in got]
        return np.frombuffer(b"".join(got), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text and where each piece begins and ends in its UTF-8 bytes."""
        if not self.by_words:
            body, source = self.normalise(text)
            if self.exact_lengths:
                ids = np.array(self.segment.encode(body), "<u4")
                lengths = self.lengths[ids]
            else:  # an unknown run is one piece of any length
                made = self.segment.encode(body, return_type="proto").pieces
                ids, lengths = np.array([p.id for p in made], "<u4"), np.array([len(p.surface.encode()) for p in made], np.int64)
            ends = np.cumsum(lengths)
            return ids, source[ends - lengths], source[ends]
        parts, at, lo = [], 0, 0
        while lo < len(text):
            hi = lo + BLOCK
            if hi < len(text):
                m = self.normalise.word.search(text, hi)
                hi = m.start() if m else len(text)
            block = text[lo:hi]
            body, source = self.normalise(block, lo == 0)
            ids = self.words(body)
            ends = np.cumsum(self.lengths[ids])
            parts.append((ids, source[ends - self.lengths[ids]] + at, source[ends] + at))
            at += int(source[-1])
            lo = hi
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, "<u4"),) * 3


def model(path: str) -> Model:
    """A model by its file, kept by worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _lists(values: list[np.ndarray], packed: bool) -> pa.Array:
    sizes = np.array([0, *map(len, values)], np.int32)
    flat = np.concatenate([np.zeros(0, "<u4"), *values]).astype("<u4")
    if packed:
        return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.cumsum(4 * sizes, dtype=np.int32)), pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat.view("<i4")))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _encoder(path: str, begin: bool, end: bool, packed: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                made = []
                for t in texts[lo:hi]:
                    found, starts, ends = own.encode(t)
                    size = len(t.encode()) if end else 0
                    around = lambda v, a, b: np.concatenate([[a] if begin else [], v, [b] if end else []])
                    made.append((around(found, own.begin, own.end), around(starts, 0, size), around(ends, 0, size)))
                columns = [_lists(list(c), packed) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(m[0]) for m in made], pa.int64()), *columns], ["id", "n_tokens", "ids", "begins", "ends"])

    return run


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, begin: bool = True, end: bool = True, packed: bool = False) -> DataFrame:
    """(id, n_tokens, ids, begins, ends): one row for each row, in three lists of one entry a token.

    ``ids`` are exactly the library's for the model file (piece_bpe_32k.model
    unless given), with the begin and end ids if asked for. Token i stands for the
    UTF-8 bytes begins[i] up to ends[i] of the text: the spans of a text follow each
    other without gaps, but for what the model's rules drop; a piece that is part of
    what one character was rewritten to, or one of several byte pieces of a
    character, has an empty span, the last of them the whole. With ``packed`` the
    lists are binary, little-endian unsigned 32-bit, for texts below 4 GB.

    Null and empty texts have the begin and end ids alone. Every row is judged on
    its own, so repeated rows, repeated and null ids come back as they are; an empty
    table gives no rows. Texts of any length pass whole: a block at a time for
    models that allow it. Other columns are ignored, whatever their names.
    """
    path = model_file or tokenizer_file("piece_bpe_32k.model")
    bound_batches(docs.sparkSession)
    last = "binary" if packed else "array<int>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_encoder(path, begin, end, packed), f"id long, n_tokens long, ids {last}, begins {last}, ends {last}")
    return made.withColumnRenamed("id", id_col)


def _decoder(path: str, packed: bool, at: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                values = some.column(at).to_pylist()
                ids = [(np.frombuffer(v, "<u4").tolist() if packed else v) if v else [] for v in values]
                texts = own.whole.decode(ids, num_threads=1)
                out = pa.array([None if v is None else t for v, t in zip(values, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, out], [*some.schema.names, "decoded"])

    return run


def decode_pieces(df: DataFrame, ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """All columns of df, and ``decoded``: the library's text of the ids in a list or packed column; null for null ids.

    A column named decoded is replaced. An empty table gives no rows.
    """
    path = model_file or tokenizer_file("piece_bpe_32k.model")
    df = df.drop("decoded")
    shape = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)
    return df.mapInArrow(_decoder(path, packed, df.columns.index(ids_col)), shape)
