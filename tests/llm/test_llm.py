"""Corpus operators against brute force on a small table with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.llm import audio, lm_scoring, mixing, near_dedup, packing, quality, sharding, substring_dedup, toxicity, trie, words
from pairlens.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key long, bands string, record string, score double, part int, shard int, slot long, bucket int, component string, size long"


def _texts() -> list[str | None]:
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = [make(rnd.randint(5, 120)) for _ in range(25)]
    out: list[str | None] = list(base)
    for t in base[:12]:
        w = t.split()
        for k in range(3):
            v = list(w)
            v[rnd.randrange(len(v))] = rnd.choice(vocabulary)
            out.append(" ".join(v))
    passage = make(60)
    out += [f"{make(10)} {passage}\n{make(5)}" for _ in range(4)] + [passage]
    out += [None, "", "   \t\n", "one", "One", "two words", "TWO words", base[0], base[0], base[0].upper(), "x" * 30_000, make(9000), "a " * 300, "\x0b\x1fodd space here", "'s 're  \n\n don't  ", "a <|endoftext|> b<|endoftext|>"]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    random.Random(1).shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][min(i % 6, 3)], None if t is None else len(t), "x", 1, 2, "b", "r", 0.5, 3, 4, 5, 6, "c", 7) for i, t in rows]
    return spark.createDataFrame(full, DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows and null ids."""
    some = [(i, t) for i, t in rows[:12]]
    return spark.createDataFrame([(*r, None, None, None) for r in [*some, *some[:4], (None, "null id text here now"), (None, None)]], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, int(t is not None and "x" in t)) for i, t in rows] + [(None, 1, 1), (99999, None, None)], "doc_id long, quality int, toxic int")


def low_words(t):
    return WORD.findall((t or "").translate(LOW))


def shingle_set(t, k):
    w = low_words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_words_match_pattern(rows):
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    hashes, bounds = words.all_words(column, True)
    mine = [low_words(t) for _, t in rows]
    assert [len(w) for w in mine] == np.diff(bounds).tolist()
    seen = {}
    for w, h in zip(sum(mine, []), hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("keys", [np.zeros(7, np.uint64), np.arange(100, dtype=np.uint64) % 7, np.array([2**63 + i % 3 for i in range(50)], np.uint64), np.zeros(0, np.uint64)])
def test_grouped(keys):
    order, starts = words.grouped(keys)
    assert sorted(order.tolist()) == list(range(len(keys)))
    for part in np.split(order, starts[1:]) if len(keys) else []:
        assert len(set(keys[part].tolist())) == 1 and (np.diff(part) > 0).all()
    assert len(starts) == len(set(keys.tolist()))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, shingle_words=k).collect()}
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i), root(i) == i)


def test_near_duplicates_awkward(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_estimate_is_close():
    rnd = np.random.default_rng(0)
    a = np.unique(rnd.integers(0, 2**63, 4000).astype(np.uint64))
    for share in (0.0, 0.3, 0.8):
        b = np.concatenate([a[: int(len(a) * share)], np.unique(rnd.integers(0, 2**63, 4000).astype(np.uint64))[: len(a) - int(len(a) * share)]])
        keys = [near_dedup.sketch(np.sort(x), np.array([0])) for x in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(*keys, np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


@pytest.mark.parametrize("k", [3, 13, 50])
def test_substring_dedup(docs, rows, k):
    first, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        new = []
        for p in range(len(w) - k + 1):
            s = tuple(w[p : p + k])
            if first.get(s, i) < i:
                gone[p : p + k] = b"\1" * k
            new.append(s)
        for s in new:
            first.setdefault(s, i)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, min_words=k, digest=True, bucket_words=500).collect()}
    assert got == want


def test_substring_dedup_awkward(spark, odd, nothing):
    got = substring_dedup.remove_repeats(odd, min_words=3).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    assert substring_dedup.remove_repeats(nothing, min_words=3).collect() == []
    with pytest.raises(ValueError, match="at least 3"):
        substring_dedup.remove_repeats(odd, min_words=2)
    top = spark.createDataFrame([(2**63 - 1, "a b c d"), (None, "a b c d"), (-(2**63), "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(top, min_words=3).collect()) == [(-(2**63), 0), (0, 3), (2**63 - 1, 3)]
    clash = odd.selectExpr("*", "doc_id AS id", "1 AS key", "2 AS part", "text AS record", "map(1, 2) AS `a.b`")
    assert substring_dedup.remove_repeats(clash, min_words=3, carry=True).select("record.*").columns == [c for c in clash.columns if c != "text"]
    carried = substring_dedup.remove_repeats(odd, min_words=3, carry=True)
    assert carried.count() == odd.count() and set(carried.select("record.*").columns) == {"doc_id", "lang", "source", "n_chars"}


def test_suffix_order():
    rnd = np.random.default_rng(8)
    for n, width, kinds in ((0, 3, 2), (1, 3, 2), (400, 1, 5), (400, 5, 2), (300, 13, 2), (200, 4, 2**32)):
        symbols = rnd.integers(0, kinds, (n, width)).astype(np.uint32)
        ids = rnd.integers(0, 50, n)
        order, lcp = substring_dedup.suffix_order(symbols)
        assert order.tolist() == sorted(range(n), key=lambda i: (symbols[i].tolist(), i))
        by_hand = [0] + [next((k for k in range(width) if symbols[a][k] != symbols[b][k]), width) for a, b in zip(order[1:], order[:-1], strict=True)]
        assert lcp.tolist() == by_hand[:n]
        assert substring_dedup.deep_leaves(symbols, ids).tolist() == [min(ids[j] for j in range(n) if (symbols[j] == symbols[i]).all()) for i in range(n)]


def test_substring_plan_splits_large_groups():
    counts = np.zeros((4, 16), np.int64)
    counts[0, :3] = 900, 50, 50
    counts[1, :] = 60
    counts[2, :] = counts[3, :] = 10
    to = substring_dedup.plan_groups(counts, 4)
    assert to[0, 0] == -1 and (to[0, 1:3] >= 0).all() and (to[1] >= 0).all()


def test_fingerprints(docs, rows, odd, nothing):
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    got = {r.doc_id: r for r in fp.fingerprint_documents(docs, bucket_rows=9).select("*", fp.as_hex(F.col("packed")).alias("hex")).collect()}
    errors = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + other[:n]
        assert (got[i].n_chars, got[i].edited_text, got[i].next_text) == (len(t), edited, other)
        a, b = shingle_set(t.lower(), 5), shingle_set(edited.lower(), 5)
        if a and b:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06 and max(errors) < 0.3
    by_text = {}
    for i, t in order:
        assert by_text.setdefault(t, got[i].hex) == got[i].hex
    top = odd.sparkSession.createDataFrame([(-(2**63), "a b c d e f"), (None, "x"), (7, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_chars) for r in fp.fingerprint_documents(top).collect()} == {(-(2**63), 11), (None, 1), (7, 0)}
    assert fp.fingerprint_documents(odd).count() == odd.count() and fp.fingerprint_documents(nothing).count() == 0


def test_packing(docs, rows, odd, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, group_pieces=30).toPandas()
    plain = packing.pack_documents(docs, digest=True, group_pieces=30).toPandas().set_index(["doc_id", "piece"])
    for i, t in rows:
        mine = got[got.doc_id == i].sort_values("piece")
        ids = (tokenizer.encode(t, add_special_tokens=False).ids if t else []) + [2]
        assert [x for p in mine.ids for x in p] == ids and (mine.length[1:] == 1024).all()
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]]
        for r in mine.itertuples():
            assert plain.loc[(i, r.piece)].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert packing.pack_documents(odd).count() >= odd.count() and packing.pack_documents(nothing).count() == 0


def test_sum_of_squares_rule():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 101, 400)
    seq, off, made = packing.sum_of_squares(sizes, 100)
    fill, gaps = Counter(), Counter()
    best = lambda g: sum(v * v for v in g.values())
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        options = []
        for g in [*(g for g, v in gaps.items() if v and g >= s), 100]:
            after = gaps.copy()
            if g < 100:
                after[g] -= 1
            if g > s:
                after[g - s] += 1
            options.append(best(after))
        g = 100 - int(off[i])
        if g < 100:
            gaps[g] -= 1
        if g > s:
            gaps[g - s] += 1
        assert best(gaps) == min(options) and fill[seq[i]] == off[i]
        fill[seq[i]] += s
    assert made == len(fill) and made <= 1.05 * -(-sizes.sum() // 100) + 3


def test_sharding(docs, rows, odd, nothing):
    got = sharding.shard_rows(docs, "doc_id", 4, bucket_bytes=9000).select("record.doc_id", "record.text", "shard", "slot", "grown_shard").toPandas()
    assert sorted(got.doc_id) == [i for i, _ in rows] and dict(zip(got.doc_id, got.text, strict=True))[rows[0][0]] == rows[0][1]
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 4)).all() and (got.grown_shard == 4).any()
    again = sharding.shard_rows(docs, "doc_id", 4, bucket_bytes=9000).select("record.doc_id", "slot").toPandas()
    assert dict(zip(got.doc_id, got.slot, strict=True)) == dict(zip(again.doc_id, again.slot, strict=True))
    order = got[got.shard == 0].sort_values("slot").doc_id.tolist()
    assert order != sorted(order)
    assert sharding.shard_rows(odd, "doc_id", 3).count() == odd.count() and sharding.shard_rows(nothing, "doc_id", 3).count() == 0


def test_write_shards(docs, rows, spark, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "s"), "doc_id", 3, bucket_bytes=40_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == [i for i, _ in rows]
    assert max(len(list((tmp_path / "s" / f"_shard={k}").glob("*.parquet"))) for k in range(3)) > 1
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(docs.select("doc_id", "text"), "doc_id", 3, bucket_bytes=40_000).select("record.doc_id", "shard", "slot").collect()}
    assert {r.doc_id: (r._shard, r._slot) for r in back.collect()} == want
    for file in (tmp_path / "s").rglob("*.parquet"):
        slots = [r._slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)


def test_sharding_spreads_null_keys(spark):
    d = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = sharding.shard_rows(d, "doc_id", 3, bucket_bytes=500).toPandas()
    assert got["shard"].nunique() == 1 and got["bucket"].nunique() > 5 and sorted(got["slot"]) == list(range(500))


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], [0, 1, 2, 3], [2**64 - 1], [1, 2**40, 2**63, 2**64 - 2]])
def test_elias_fano_small(values):
    v = np.array(values, np.uint64)
    e = trie.EliasFano.encode(v)
    assert e.get(np.arange(len(v))).tolist() == values
    assert [values[i] for i in e.find(v)] == values
    assert e.find(np.array([7, 2**62], np.uint64)).tolist() == [values.index(x) if x in values else -1 for x in (7, 2**62)]


def test_trie_finds_within_contexts():
    rnd = np.random.default_rng(4)
    contexts = np.unique(rnd.integers(0, 2**64 - 1, 300, dtype=np.uint64))
    rank = np.sort(rnd.integers(0, len(contexts), 4000))
    key = np.unique((rank.astype(np.uint64) << np.uint64(40)) | rnd.integers(0, 2**40, 4000, dtype=np.uint64))
    rank, word = (key >> np.uint64(40)).astype(np.int64), key & np.uint64(2**40 - 1)
    score, below = rnd.integers(0, 200, len(key)) / 7.0, np.arange(len(contexts)) / 3.0
    t = trie.NGramTrie.build(contexts, below[:256].repeat(2)[: len(contexts)], rank, word, score).mapped()
    value, seen = t.query(contexts, rank, word)
    assert seen.all() and value.tolist() == score.tolist()
    other = (rank + 1) % len(contexts)
    value, seen = t.query(contexts, other, word)
    assert not seen.any() and value == pytest.approx(below[:256].repeat(2)[other])
    value, seen = t.query(np.array([12345], np.uint64), np.zeros(3, np.int64), word[:3])
    assert not seen.any() and not value.any()


def test_elias_fano_random():
    rnd = np.random.default_rng(2)
    for n, top in ((1000, 2**64 - 1), (5000, 20_000), (300, 301)):
        v = np.unique(rnd.integers(0, top, n, dtype=np.uint64))
        e = trie.EliasFano.encode(v)
        assert (e.get(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, rnd.integers(0, top, n, dtype=np.uint64)])
        where = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(asked).tolist() == [where.get(x, -1) for x in asked.tolist()]


@pytest.mark.parametrize("hot_tokens", [10**9, 150])
def test_lm_scores(docs, rows, odd, nothing, hot_tokens):
    train = F.col("doc_id") % 4 != 1
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, train, bucket_tokens=3000, hot_tokens=hot_tokens).collect()}
    tokens = {i: [*low_words(t), "</s>"] for i, t in rows}
    c, pairs, contexts = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if i % 4 != 1:
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
            contexts.update(["<s>", *w[:-1]])
    n, v = sum(c.values()), len(c)
    kinds = Counter(u for u, _ in pairs)
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for u, x in zip(["<s>", *w[:-1]], w, strict=True):
            if pairs[u, x]:
                score += math.log10((pairs[u, x] - 0.75) / contexts[u])
            else:
                score += (math.log10(0.75 * kinds[u] / contexts[u]) if contexts[u] else 0) + math.log10((c[x] + 1) / (n + v + 1))
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 != 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert r.score == pytest.approx(score, rel=0.03, abs=1.5)
    assert len(lm_scoring.lm_scores(odd, train).collect()) == odd.count()
    assert lm_scoring.lm_scores(nothing, train).collect() == []


def test_lm_hot_contexts_are_exact(spark):
    """Split contexts of few successors, over many buckets, score as unsplit ones do."""
    rows = [(i, " ".join(f"hot s{(i + j) % 5} c{(i * 7 + j) % 40}" for j in range(30)) if i % 4 else f"hot new{i} s1 hot c3 hot c{i}") for i in range(120)]
    docs, train = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 0
    split, whole = ({r.doc_id: r.score for r in lm_scoring.lm_scores(docs, train, bucket_tokens=300, hot_tokens=h).collect()} for h in (100, 10**9))
    assert len(split) == len(rows) and split == pytest.approx(whole, rel=1e-6)


def test_mixing(docs, rows, odd, nothing):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(rows) and (got["size"] == [len(WORD.findall(t or "")) for _, t in sorted(rows)]).sum() >= 0
    sizes = {i: len(WORD.findall(t or "")) for i, t in rows}
    assert all(sizes[r.doc_id] == r.size and 0 <= r.taken <= 2 * r.size for r in got.itertuples())
    total = 1.5 * got["size"].sum()
    assert got.groupby(got.source.fillna("~")).target.first().sum() == pytest.approx(total)
    for _, g in got.groupby(got.source.fillna("~")):
        assert g.target.iloc[0] <= 2 * g["size"].sum() + 1e-6
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(30, 0.05 * g.target.iloc[0], g["size"].max() / 2)
    again = mixing.mix_sources(docs).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(nothing).count() == 0


def test_targets_by_hand(spark):
    src = spark.createDataFrame([(False, "a", 10, 1.0, 1), (False, "b", 1000, 1.0, 1), (True, "", 100, 1.0, 1)], "no_source boolean, src string, words long, mean double, least long")
    got = {r.src: r.target for r in mixing.targets(src, (3, 1, 2), 1.5, 2).collect()}
    assert got == {"a": 20.0, "": 200.0, "b": pytest.approx(1665 - 220)}


def _toy(spark, n=600):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(10, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["vile.", "Nasty", "foul"])
        rows.append((i, " ".join(w), "h", "p"))
        labels.append((i, 1 - int(bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, labels, odd, nothing):
    d, l = _toy(spark)
    got = toxicity.toxicity(d, l, F.col("doc_id") % 4 != 2).join(l, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert ((got.predicted == got.toxic).mean() > 0.97) and got.score.between(0, 1).all()
    out = toxicity.toxicity(docs, labels, F.lit(True))
    assert out.count() == docs.count() and out.where("score is null or predicted is null").isEmpty()
    assert toxicity.toxicity(odd, labels, F.lit(True)).count() == odd.count()
    assert toxicity.toxicity(nothing, labels, F.lit(True)).count() == 0
    none = toxicity.toxicity(d, l.where("toxic = 0"), F.lit(True))
    assert none.where("score <> 0").isEmpty() and none.count() == 600


def test_toxicity_fixed_wording(spark):
    """Words that always follow the same word are judged by their pairs."""
    rows = [(f"w{i % 7} w{i % 5} you vile nasty foul thing w{i % 3}" if i % 4 == 0 else f"w{i % 7} w{i % 5} you w{i % 3}", 2 * (i % 4 == 0) + i // 4 % 2) for i in range(160)]
    ratios = toxicity.fit_ratios(spark.createDataFrame(rows, "text string, cell int"))
    w = next(words.blocks(pa.array(["you vile nasty foul thing"]), True, bare=True))[2]
    assert (ratios.of(w, 2)[2:] > 1).all()


def test_toxicity_likelihoods(spark):
    """log P(toxic) - log P(ordinary) of every word after every other, against interpolated Kneser-Ney models by hand."""
    rnd = random.Random(6)
    vocabulary = [f"{a}{'xyzvw'[k % 5] * 5}{k}" for k, a in enumerate("abcdefghijkl")]
    rows = [(" ".join(rnd.choice(vocabulary[: 6 + 3 * (i % 3)]) for _ in range(40)), 2 * (i % 3 == 2) + i % 2) for i in range(60)]
    ratios = toxicity.fit_ratios(spark.createDataFrame(rows, "text string, cell int"))
    d, both = toxicity.DISCOUNT, [Counter(), Counter()]
    for text, cell in rows:
        w = text.split()
        both[cell // 2].update(zip(["", *w[:-1]], w, strict=True))
    stem = lambda w: w[: toxicity.STEM_BYTES]

    def model(pairs):
        after = Counter(w for _, w in pairs)
        pooled = Counter(w for _, w in {*both[0], *both[1]})
        stems, all_stems = Counter(), Counter()
        for w, n in after.items():
            stems[stem(w)] += n
        for w, n in pooled.items():
            all_stems[stem(w)] += n
        taken = lambda c: sum(min(x, d) for x in c.values())
        n = sum(after.values())
        p_stem = lambda s: max(stems[s] - d, 0) / n + taken(stems) / n * all_stems[s] / sum(all_stems.values())
        p_word = lambda w: max(after[w] - d, 0) / n + taken(after) / n * p_stem(stem(w)) * pooled[w] / all_stems[stem(w)]

        def p(u, w):
            under = {x: c for x, c in pairs.items() if x[0] == u}
            total = sum(under.values())
            return (max(pairs[u, w] - d, 0) + taken(under) * p_word(w)) / total if total else p_word(w)

        return p

    ordinary, toxic = map(model, both)
    for u in vocabulary:
        texts = pa.array([f"{u} {w}" for w in vocabulary])
        block = next(words.blocks(texts, True, bare=True))[2]
        got = ratios.of(block, 2)[1::2]
        assert got == pytest.approx([math.log(toxic(u, w) / ordinary(u, w)) if w in {x for _, x in {*both[0], *both[1]}} else 0.0 for w in vocabulary], abs=1e-9)


def test_quality(spark, docs, labels, odd, nothing):
    d, l = _toy(spark)
    junk = d.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.repeat(F.lit("SAME!! "), 30)).otherwise(F.col("text")))
    got = quality.quality(junk, l, F.col("doc_id") % 4 != 2).join(l, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert (got.keep.astype(int) == got.quality).mean() > 0.98
    for frame in (docs, odd, nothing):
        out = quality.quality(frame, labels, F.lit(True))
        assert out.count() == frame.count() and out.where("score is null or isnan(score)").isEmpty()


def test_quality_borrows_from_sites(spark):
    """Where text says little, a site's other documents correct it, and a site with one document says nothing."""
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(1500):
        host = i % 30
        good = rnd.random() < (0.05 if host < 15 else 0.95)
        marks = sum(rnd.random() < (0.10 if good else 0.16) for _ in range(60))
        rows.append((i, " ".join(["word!" if k < marks else f"word{k}" for k in range(60)]), f"h{host}", f"p{i % 2}"))
        labels.append((i, int(good)))
    rows.append((5000, rows[0][1], "alone", "p0"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality(d, l, F.col("doc_id") % 4 != 2).toPandas().set_index("doc_id")
    held = [(got.loc[i], y) for i, y in labels if i % 4 == 2]
    by_text = np.mean([(r.evidence >= 0.5) == y for r, y in held])
    by_site = np.mean([(r.score >= 0.5) == y for r, y in held])
    assert by_site > by_text + 0.03 and by_site > 0.8
    assert abs(got.loc[5000].score - got.loc[5000].evidence) < 0.1 < max(abs(r.score - r.evidence) for r, _ in held)
    assert got.loc[[i for i, y in labels if i % 30 < 15]].host_posterior.max() < got.loc[[i for i, y in labels if i % 30 >= 15]].host_posterior.min()


def test_audio(spark):
    rnd = np.random.default_rng(7)
    tones = [rnd.integers(0, 48, 80) for _ in range(30)]
    t = np.arange(250) / 4000
    bank = np.sin(2 * np.pi * (110 * 2 ** (np.arange(48) / 12))[:, None] * t)

    def pcm(notes, noise=0.0):
        x = bank[notes].reshape(-1)
        return ((x + noise * rnd.standard_normal(len(x))) * 12000).clip(-32768, 32767).astype("<i2").tobytes()

    rows = [(i, pcm(n)) for i, n in enumerate(tones)]
    rows += [(100 + i, pcm(n[10:70])) for i, n in enumerate(tones[:10])]
    rows += [(200 + i, pcm(n, 0.02)) for i, n in enumerate(tones[:10])]
    rows += [(300, pcm(tones[0])), (400, None), (401, b""), (402, b"\0" * 40_000)]
    media = spark.createDataFrame(rows, "id long, audio binary")
    prints = audio.fingerprint_audio(media, "id", "audio")
    got = {r.id: r for r in audio.align_recordings(prints, F.col("id") >= 100).collect()}
    assert len(got) == len(rows)
    found = sum((got[200 + i].best_match, got[200 + i].best_offset) in ((i, 0), (100 + i, -10)) for i in range(10))
    cut = sum(got[100 + i].best_match in (i, 200 + i) and got[100 + i].best_offset == 10 for i in range(10))
    assert found >= 9 and cut >= 9
    assert got[300].class_id == 0 and got[300].best_match == 0 and got[300].n_links >= 2
    assert got[400].n_codes == 0 and got[400].n_links is None and got[5].n_links is None
    exact = {r.id: np.array(r.codes, np.int32).view(np.uint32) for r in prints.collect()}

    def error(a, b):
        best = 1.0
        for off in range(-len(a) + 16, len(b) - 15):
            x, y = a[max(0, -off) :], b[max(0, off) :]
            m = min(len(x), len(y))
            if m >= 16:
                best = min(best, np.unpackbits((x[:m] ^ y[:m]).view(np.uint8)).sum() / (32 * m))
        return best

    near = {(q, o) for q in exact if q >= 100 and q < 300 for o in exact if o != q and len(exact[o]) and error(exact[q], exact[o]) <= 0.06}
    links = {(r.a, r.b) for r in audio.recording_links(prints, F.col("id") >= 100).collect() if r.a >= 100}
    small = {o: min(i for i in exact if exact[i].tolist() == exact[o].tolist()) for o in exact if len(exact[o])}
    near = {(q, small[o]) for q, o in near if small[q] == q}
    assert links <= near | {(q, o) for q, o in links if q >= 300} and len(links & near) >= 0.9 * len(near) > 0
    with pytest.raises(ValueError):
        audio.align_recordings(prints, F.lit(True), min_overlap=audio.WIDTH)


def test_audio_awkward(spark):
    rows = [(None, [1] * 40), (1, None), (2, []), (3, [7] * 40), (3, [7] * 40), (4, list(range(40)))]
    d = spark.createDataFrame(rows, "id long, codes array<int>").withColumn("key", F.lit(1)).withColumn("class_id", F.lit(2))
    got = audio.align_recordings(d, F.col("id") >= 3).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 3, 4] and all(r.n_links == 1 for r in got if r.id == 3)
    assert audio.align_recordings(d.limit(0), F.lit(True)).collect() == []


def test_audio_repeated_parts(spark):
    """An excerpt [X Z] of [X Y X Z] is found where it matches, not at the first X."""
    x, y, z = (np.random.default_rng(i).integers(-(2**31), 2**31, n).tolist() for i, n in enumerate((40, 30, 25)))
    prints = spark.createDataFrame([(1, x + y + x + z), (2, x + z), (3, [5] * 60), (4, [5] * 40 + z)], "id long, codes array<int>")
    got = {r.id: r for r in audio.align_recordings(prints, F.col("id") == 2).collect()}
    assert (got[2].best_match, got[2].best_offset, got[2].best_error) == (1, 70, 0.0)
    same = np.full(60, 5, np.uint32)
    assert audio.voted_offsets(same, same[:40]).tolist() == list(range(8 - 60 + 1, 40 - 8))


@pytest.fixture
def corpus(spark, rows, tmp_path):
    """Documents and labels on disk: ordinary rows, toxic ones, repeated ids, null ids and clashing columns."""
    extra = [(1000 + i, f"{t} you vile nasty foul thing", "en", "s1", 1) for i, (_, t) in enumerate(rows[:40])]
    base = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    odd = [(5, "another text under the id five altogether", "en", None, 41), (None, "no id here but words", None, "s1", None), (None, "no id here but words", None, "s1", None), (None, None, None, None, None)]
    d = spark.createDataFrame(base + extra + odd, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(("k", "i", "copies", "row", "record", "id", "component_id", "a.b")):
        d = d.withColumn(name, F.lit(i))
    l = spark.createDataFrame([(i, 1, 0) for i, *_ in base] + [(i, 1, 1) for i, *_ in extra], "doc_id long, quality int, toxic int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    l.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), base + odd, extra


def test_pipeline(spark, corpus):
    """Each stage against what plain Python makes of the rows that the stage before kept."""
    import corpus_pipeline as cp

    folder, clean, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{n}")
        docs = spark.read.parquet(f"{folder}/out{n}")
        seen[name] = docs.collect()
        assert n == len(cp.STAGES) - 1 or docs.columns == columns
    ids = Counter(r.doc_id for r in seen["toxicity"])
    assert sum(ids[i] for i, *_ in toxic) <= 4 and sum(ids[i] for i in {i for i, *_ in clean}) >= len(clean) - 2

    docs_in = list(dict.fromkeys((r.doc_id, r.text) for r in seen["toxicity"]))
    sets, parent = [shingle_set(t, 5) for _, t in docs_in], list(range(len(docs_in)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups: dict[int, list] = {}
    for i, d in enumerate(docs_in):
        groups.setdefault(root(i), []).append(d)
    kept = [(r.doc_id, r.text) for r in seen["near_dedup"]]
    assert len(kept) == len(groups)
    for group in groups.values():
        mine = [d for d in kept if d in group]
        assert len(mine) == 1 and (mine[0][0] is None) <= all(i is None for i, _ in group) and (mine[0][0] is None or mine[0][0] == min(i for i, _ in group if i is not None))

    key = lambda i: (i is None, i or 0)
    first: dict[tuple, tuple] = {}
    windows = [(i, t, WORD.findall(t or "")) for i, t in kept]
    for i, _, w in windows:
        for p in range(len(w) - 49):
            s = tuple(w[p : p + 50])
            first[s] = min(first.get(s, key(i)), key(i))
    want = []
    for i, t, w in windows:
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < key(i) for q in range(p, p + 50)}
        if len(gone) < len(w) or not w:
            want.append((i, " ".join(x for q, x in enumerate(w) if q not in gone) if gone else t))
    got = [(r.doc_id, r.text) for r in seen["substring_dedup"]]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) < len(kept) + 1
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"] if r.text is not None and r.n_chars is not None and r.doc_id is not None and r.doc_id < 1000)

    size = lambda t: len(WORD.findall(t or ""))
    copies = Counter((r.doc_id, r.text) for r in seen["mixing"])
    assert set(copies) <= set(got) and all(copies[d] <= 2 * got.count(d) for d in copies)
    total = sum(size(t) for _, t in got)
    assert abs(sum(size(t) * n for (_, t), n in copies.items()) - 1.5 * total) <= 0.1 * total

    pieces: dict[int, list] = {}
    for r in seen["packing"]:
        pieces.setdefault(r.sequence_id, []).append(r)
    for s in pieces.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and sum(r.length for r in s) <= 1024
    assert sum(r.ids[-1] == 2 and r.start + r.length >= 1 and len(r.ids) == r.length for r in seen["packing"]) >= len(seen["mixing"])


def test_pipeline_run_resumes(spark, corpus, monkeypatch):
    import corpus_pipeline as cp

    folder, _, _ = corpus
    calls = []

    def stage(name, fails):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError("lost")
            return docs.withColumn(name, F.lit(name))

        return name, run

    monkeypatch.setattr(cp, "STAGES", [stage("one", False), stage("two", True), stage("three", False)])
    name = f"test-{folder.rsplit('/', 1)[1]}"
    with pytest.raises(RuntimeError):
        cp.run(spark, folder, name)
    assert {"one", "two", "three"} <= set(cp.run(spark, folder, name).columns) and calls == ["one", "two", "two", "three"]


def test_pipeline_stages_on_nothing(spark, corpus):
    import corpus_pipeline as cp

    folder, _, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).collect() == []
