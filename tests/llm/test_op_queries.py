"""The registered corpus queries on the smallest tables, column by column against plain Python or DuckDB."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from pairlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def run(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, SF).collect()
    return {r[key]: r for r in rows}, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    result = con.execute(ORACLES[name])
    names = sorted(d[0] for d in result.description)
    want = sorted(tuple(dict(zip([d[0] for d in result.description], r, strict=True))[c] for c in names) for r in result.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names and sorted(tuple(r) for r in df.select(*names).collect()) == want


def test_op3(spark, docs):
    got, rows = run(spark, "op3_fingerprints")
    order = sorted(docs, key=lambda d: -d["doc_id"])
    assert len(rows) == len(docs)
    prints = {}
    for i, d in enumerate(order):
        text, after = d["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        n = len(text) // 3
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    from pairlens.llm.packing import tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    _, rows = run(spark, "op6_packing")
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    total = 0
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[d["doc_id"]], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
        assert sum(r.length for r in mine) == len(ids) and len(mine) == -(-len(ids) // 1024)
        total += len(ids)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and s[-1].offset + s[-1].length <= 1024
    assert len(sequences) <= 1.1 * -(-total // 1024) + 2


def test_op7(spark, docs):
    got, rows = run(spark, "op7_sharding")
    assert len(rows) == len(docs)
    for d in docs:
        data = (d["text"] or "").encode()
        r = got[d["doc_id"]]
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for k in range(24):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_op8(spark, docs):
    got, rows = run(spark, "op8_lm_scoring")
    tokens = {d["doc_id"]: [*WORD.findall((d["text"] or "").translate(LOW)), "</s>"] for d in docs}
    c = Counter(w for i, t in tokens.items() if remainder(i, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9) and r.score < 0


def test_op9(spark, docs):
    got, rows = run(spark, "op9_mixing")
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    words = Counter()
    for d in docs:
        words[d["source"]] += size[d["doc_id"]]
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(words.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * words[s]]
        for s in full or open_.copy():
            target[s] = 2.0 * words[s] if full else level * weight[s]
            left -= target[s] if full else 0
            open_.discard(s)
    taken = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r.source_size) == (size[d["doc_id"]], words[d["source"]]) and r.target == pytest.approx(target[d["source"]]) and 0 <= r.taken <= 2 * r["size"]
        taken[d["source"]] += r.taken
    largest = {s: max(size[d["doc_id"]] for d in docs if d["source"] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2) for s in order)
    assert {r.doc_id: r.taken for r in QUERIES["op9_mixing"](spark, SF).collect()} == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("name", ["op4_quality", "op10_toxicity"])
def test_classifiers(spark, docs, name):
    got, rows = run(spark, name)
    assert sorted(got) == sorted(d["doc_id"] for d in docs) and len(rows) == len(docs)
    assert all(r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    if name == "op10_toxicity":
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)
        by_text: dict = {}
        for d in docs:
            assert got[d["doc_id"]].score == pytest.approx(by_text.setdefault(d["text"] or "", got[d["doc_id"]].score), rel=1e-9)


def test_op5(spark):
    got, rows = run(spark, "op5_audio", "vec_id")
    assert len(rows) == pq.read_metadata(f"{SF}/embeddings.parquet").num_rows
    assert all((r.n_links is not None) == (i % 20 == 0) for i, r in got.items() if r.n_codes)
    # each query has one planted copy, seven ids on, from a third of it on; nothing else is alike
    asked = [i for i in got if i % 20 == 0 and i + 7 in got]
    found = [i for i in asked if got[i].n_links and got[i].best_match == got[i + 7].class_id]
    assert len(asked) > 5 and len(found) >= 0.9 * len(asked) and sum(r.n_links or 0 for r in rows) <= 1.1 * len(asked)
    assert all(got[i].best_offset != 0 for i in found)
