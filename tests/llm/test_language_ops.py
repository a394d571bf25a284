"""Collocations, pieces and the conversation trie against plain Python, on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairlens.llm import collocations as co
from pairlens.llm import conversation_trie as ct
from pairlens.llm import pieces as pc
from pairlens.llm.packing import tokenizer_file
from pairlens.llm.queries import QUERIES

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizer_file("piece_bpe_32k.model")
#: Names that the operators use inside.
CLASH = "doc_id long, text string, lang string, n long, phrase string, part string, rank long, words long, id string, ids string, begins int, w string, decoded string"
LOW = {i: i + 32 for i in range(65, 91)}


def texts(n=260):
    rnd = random.Random(5)
    vocabulary = [*"of the a Ünder straße x y don't z\x1f".split(" "), *("w%d" % i for i in range(12))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    make = lambda k: "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "! "]) for w in rnd.choices(vocabulary, weights, k=k))
    out = [make(rnd.randint(0, 40)) for _ in range(n)]
    return [*out, None, "", " \t.,\n", "of", "OF THE", "of of of of of of of of of of of of of", make(4000), out[3], out[3], out[3].upper(), "▁ ▁a  b", "😀①\x00"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][min(i % 5, 2)], 7, "p", "q", 1, 2, "i", "j", 3, "w", "d") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, "of the of the", None, *rows[0][3:])], CLASH).repartition(5).cache()


def brute_collocations(rows, max_words, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in found.items()):
                continue
            s, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "least", "percent", "top"), [(3, 10, 50, 2000), (2, 3, 50, 5), (4, 4, 80, 30)])
def test_collocations(docs, max_words, least, percent, top):
    got = co.collocations(docs, max_words=max_words, min_count=least, inside_percent=percent, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()], max_words, least, percent, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_small_tables_and_blocks_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, co.collocations(docs, min_count=4).collect()))
    monkeypatch.setattr(co, "BITS", (1 << 15, 1 << 15))  # one piece of the bit table
    monkeypatch.setattr(co, "BITS_EACH", 0)
    monkeypatch.setattr(co, "COMMON", 3)
    assert sorted(map(tuple, co.collocations(docs, min_count=4).collect())) == want


def test_full_bit_table_loses_nothing():
    block = co.Block(["a b a b", "a b. a"])
    words = lambda found: dict(zip(found[0].to_pylist(), found[1].tolist(), strict=True))
    assert words(block.phrases(1, 1, None)) == {"a": 4, "b": 3}
    assert words(block.phrases(2, 1, np.full(16, 255, np.uint8))) == {"a b": 3, "b a": 1}
    assert words(block.phrases(3, 1, np.full(16, 255, np.uint8))) == {"a b a": 1, "b a b": 1}
    assert words(block.phrases(3, 1, np.zeros(16, np.uint8))) == {}
    assert words(co.Block([""]).phrases(2, 1, np.full(16, 255, np.uint8))) == {}


def test_exact_scores(spark):
    """Products past 64 bits: counts of 10^10 in a level table score as integers do."""
    a, left, right = 9_999_999_967, 10_000_000_019, 10_000_000_033
    row = spark.sql(f"SELECT (CAST({a} AS DECIMAL(19, 0)) * CAST({a} AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0))) AS s").first()
    assert row.s == 10**6 * a * a // (left * right)


def test_nothing_has_no_collocations(spark):
    assert co.collocations(spark.createDataFrame([], CLASH)).collect() == []
    assert co.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).collect() == []


def spans(model_file, text):
    made = sentencepiece.SentencePieceProcessor(model_file=model_file).encode(text, return_type="proto").pieces
    size = len(text.encode())
    return [1, *(p.id for p in made), 2], [0, *(p.begin for p in made), size], [0, *(p.end for p in made), size]


@pytest.mark.parametrize("packed", [False, True])
def test_pieces(docs, packed):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = pc.decode_pieces(pc.encode_pieces(docs, packed=packed))
    assert made.columns == ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        lists = [np.frombuffer(v, "<u4").tolist() if packed else v for v in (r.ids, r.begins, r.ends)]
        t = text[r.doc_id]
        ids = processor.encode(t, add_bos=True, add_eos=True)
        assert lists[0] == ids and r.n_tokens == len(ids) and r.decoded == processor.decode(ids)
        assert tuple(lists) == spans(MODEL, t) if len(t) < 500 and t else lists[1][0] == 0
        assert lists[1][1:] == lists[2][:-1] and lists[2][-1] == len(t.encode())  # no gaps


def test_without_marks_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, None), (None, "")], "doc_id long, text string")
    assert sorted((r.n_tokens, r.ids) for r in pc.encode_pieces(rows, begin=False, end=False).collect()) == [(0, []), (0, []), (2, sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("a b"))]
    assert pc.decode_pieces(pc.encode_pieces(rows.limit(0))).collect() == []
    assert [r.decoded for r in pc.decode_pieces(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == [None, ""]


def varint(n):
    return (b"" if n < 128 else bytes([n & 127 | 128])) + (varint(n >> 7) if n >= 128 else bytes([n]))


def test_varint():
    assert dict(pc.fields(b"\x08" + varint(300) + b"\x12" + varint(3) + b"abc" + b"\x1d1234")) == {1: 300, 2: b"abc", 3: b"1234"}


@pytest.mark.parametrize("rules", ["nfkc", "nmt_nfkc_cf"])
def test_compiled_maps(tmp_path, rules, monkeypatch):
    """The library's own maps put into the model, with every way of treating spaces: ids and spans are the library's."""
    place = os.path.join(os.path.dirname(sentencepiece.__file__), "package_data", f"{rules}.bin")
    if not os.path.exists(place):
        pytest.skip("no compiled maps")
    compiled, raw = open(place, "rb").read(), open(MODEL, "rb").read()
    rnd = random.Random(2)
    some = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "ﬁ", "①", "▁", "漢", "か", "゙", "😀", "\x00", "\x01", " ", "¨", "<s>", "<0x41>", "ｱ", "ﾞ", "​", "word ", "…", "ﷺ"]
    cases = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(250)] + ["", " ", "  a  ", " ", "\x01", "A" * 200 + " b" * 200]
    for extra, prefix, suffix in [(0, 1, 0), (1, 1, 0), (1, 0, 0), (0, 1, 1), (1, 1, 1)]:
        section = b"\x12" + varint(len(compiled)) + compiled + b"\x18" + bytes([prefix]) + b"\x20" + bytes([extra])
        file = tmp_path / f"{extra}{prefix}{suffix}.model"
        file.write_bytes(raw + b"\x1a" + varint(len(section)) + section + b"\x12\x03\xc0\x01" + bytes([suffix]))
        model, library = pc.Model(str(file)), sentencepiece.SentencePieceProcessor(model_file=str(file))
        for block in (1 << 16, 16):
            monkeypatch.setattr(pc, "BLOCK", block)
            for t in cases:
                made = library.encode(t, return_type="proto").pieces
                assert [list(map(int, v)) for v in model.encode(t)] == [[p.id for p in made], [p.begin for p in made], [p.end for p in made]], (t, extra, prefix, suffix)


def test_op12(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, sf).collect()}
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(rows) == len(table)
    for d in table:
        ids = processor.encode(d["text"] or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest())
        assert (rows[d["doc_id"]].n_tokens, rows[d["doc_id"]].ids_sha256, rows[d["doc_id"]].decoded_sha256) == want


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full = own.get(base, [])[:h] + mine[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, d == len(full)))
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted((low[p], len(p), low[p[:-1]] if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest()) for p, m in members.items())


def conversation_rows():
    rnd = random.Random(9)
    rows = []
    for c in [*range(0, 260), *range(400, 460), -5, -100, 1999, 2**40]:
        if c % 100 == 0 and c == 400:
            continue  # no beginning to take
        for turn in range(rnd.choice([1, 2, 3, 6, 8])):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "é😀", "", None, "yes"])))
    rows += [(50, None, "system", "first"), (51, 2, "user", "again"), (51, 2, "user", "again"), (None, 1, "user", "nobody")]
    rows += [(3000 + i, t, "user", "same") for i in range(300) for t in range(7)]  # copies
    rows += [(7000, t, "user", f"t{t}") for t in range(400)]
    return rows


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize(("chunk", "common"), [(1 << 16, 2000), (8, 3)])
def test_conversation_trie(spark, monkeypatch, chunk, common):
    monkeypatch.setattr(ct, "CHUNK", chunk)
    monkeypatch.setattr(ct, "COMMON", common)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "k", "p", 1) for r in rows], "conv_id long, turn long, role string, text string, keys string, path string, n int").repartition(7)
    made = ct.conversation_trie(df).cache()
    assert trie_rows(made) == brute_trie(rows)
    at = sorted((r.position, r.end_position, r.depth) for r in made.collect())
    assert [a for a, _, _ in at] == list(range(1, len(at) + 1))
    for i, (a, b, d) in enumerate(at):  # a subtree is the run of deeper nodes that follow
        j = i + 1
        while j < len(at) and at[j][2] > d:
            j += 1
        assert b == j


def test_trie_of_little(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert ct.conversation_trie(spark.createDataFrame([], shape)).collect() == []
    some = [(401, 0, None, None), (None, 0, "user", "x")]
    assert trie_rows(ct.conversation_trie(spark.createDataFrame(some, shape))) == brute_trie(some)
    turnless = spark.createDataFrame([(1, []), (2, [])], "conv_id long, turns array<struct<key: binary, len: long>>")
    assert trie_rows(ct.prefix_trie(turnless)) == [(1, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"1,2").hexdigest())]


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 7 - 3 AS v").repartition(5)
    got = [r.to_v for r in ct.running_sums(df, ["k"], ["v"]).orderBy("k").collect()]
    assert got == np.cumsum(np.arange(1000) % 7 - 3).tolist()
