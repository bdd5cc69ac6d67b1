"""Whitening, BPE encoding and alignment against brute force, exact arithmetic and the tokenizers' own libraries."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cirrostrat.llm import alignment, bpe, whitening
from cirrostrat.llm import queries as llm_queries
from tests.compare import DATA

WORD, BYTE, PIECE = llm_queries.WORD_VOCABULARY, llm_queries.BYTE_VOCABULARY, llm_queries.PIECE_MODEL
ALPHABET = "aaabbcde theingxyzéß'sSΣİ  \n\t0123456789!?…漢字かな한국՘́\x85\x1c▁\x00🙂"


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def odd_texts(seed=1, n=300):
    rng = random.Random(seed)
    words = ["<|endoftext|>", "<|startoftext|>", "<s>", "<unk>", "it's", "we'LL", "ΑΣ", "é", "of the"]
    out = ["".join(rng.choice(words) if rng.random() < 0.05 else rng.choice(ALPHABET) for _ in range(rng.randrange(0, 80))) for _ in range(n)]
    return [None, "", " ", "\n\t ", "<|endoftext|>", "<|endoftext", "a" * 5000, "ab " * 4000, "<|endoftext|>́e", *out, out[5], out[5]]


# ---- 11 -------------------------------------------------------------------------------------


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def exact_moments(vectors):
    fit = sorted({whole(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    away = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(d)] for i in range(d)])
    return n, s, cov


def check_whitening(rows, vectors, components=16):
    n, s, cov = exact_moments(vectors.values())
    d = len(s)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(vectors)
    signs = None
    for name, v in vectors.items():
        assert sorted(by[name]) == list(range(1, min(components, d) + 1))
        x = whole(v)
        away = [n * a - b for a, b in zip(x, s, strict=True)]
        want = np.array([a / n for a in away]) @ axes / np.sqrt(values)
        got = np.array([by[name][c + 1].whitened for c in range(len(values))])
        if signs is None:
            signs = np.sign(got * want)
        np.testing.assert_allclose(got, want * signs, atol=1e-8)
        for c, r in by[name].items():
            assert r.n == n and r.deviation == sum(a * a for a in away) and r.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    good = {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    check_whitening(llm_queries.op11_embedding_whitening(spark, DATA).collect(), good)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: [float(c) for c in v] for i, v in enumerate(rng.normal(1e4, 3, (60, 5)).astype(np.float32) * np.array([1, 2, 3, 4, 5], np.float32))}
    vectors |= {100 + i: vectors[3] for i in range(40)}  # a group of copies counts once
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, [])]
    rows = [(i, v, "x", 1.0) for i, v in [*vectors.items(), *bad]] + [(3, vectors[3], "again", 2.0), (None, vectors[4], "x", 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n double").repartition(7)
    out = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in out)[3] == 10 and Counter(r.vec_id for r in out)[None] == 5
    first = {(r.vec_id, r.component): r for r in out}
    check_whitening([r for r in first.values() if r.vec_id is not None], vectors)
    assert all(first[None, c].whitened == first[4, c].whitened for c in range(1, 6))


def test_whitening_of_lengths_constants_and_far_entries(spark):
    rows = [(i, [float(i % 7), 2.0]) for i in range(20)] + [(100 + i, [float(i), float(i * i), 1.0]) for i in range(9)] + [(200, [3e38, -3e38, 0.0, 1.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    flat = {(r.vec_id, r.component): r for r in out}
    assert len(out) == 20 * 2 + 9 * 3 + 4
    assert flat[0, 1].n == 7 and flat[0, 1].explained == 1.0 and flat[0, 2].whitened is None and flat[0, 2].explained == 0 and flat[0, 2].identity_error < 1e-9
    assert flat[100, 1].n == 9 and flat[100, 3].whitened is None
    assert flat[200, 1].n == 1 and flat[200, 1].deviation == 0 and flat[200, 1].whitened is None and flat[200, 1].identity_error is None
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    apart = whitening.whole_vectors(spark.createDataFrame([(1, [3e38, -3e38])], "vec_id int, embedding array<float>")).first().x
    assert apart == [2**60 + 1_000_000, -(2**60) + 1_000_000]


def test_moments_merge_like_one_stream():
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 9, (400, 6)) * [1, 1, 2, 3, 5, 8]).astype(np.int64) + 10**15
    parts = [whitening.Moments(p[0]) for p in np.array_split(x, 9)]
    for m, p in zip(parts, np.array_split(x, 9), strict=True):
        m.add(p)
    while len(parts) > 1:
        parts[0].merge(parts.pop())
    centred = (x - 10**15).astype(float)
    np.testing.assert_allclose(parts[0].covariance(), np.cov(centred.T, ddof=0), rtol=1e-11)
    assert parts[0].n == 400 and parts[0].total == [int(s) for s in x.sum(axis=0)]


def test_reduction_tree_of_many_states(spark):
    df = spark.range(0, 500, 1, 80).selectExpr("array(id, id * id, id % 7) as x")  # 80 states: two levels
    got = whitening.moments(df)[3]
    x = np.array([[i, i * i, i % 7] for i in range(500)], float)
    np.testing.assert_allclose(got.covariance(), np.cov(x.T, ddof=0), rtol=1e-11)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    m = np.random.default_rng(d).normal(size=(3 * d, d)) * np.arange(1, d + 1)
    v = m.T @ m
    values, axes = whitening.symmetric_qr(v)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
    np.testing.assert_allclose(axes.T @ axes, np.eye(d), atol=1e-12)
    np.testing.assert_allclose(v @ axes, axes * values, atol=1e-12 * values[0])


@pytest.mark.parametrize("v", [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.diag([3.0, 1, 2]), np.array([[0, 1.0], [1, 0]]), np.diag([1e-300, 1e300])])
def test_symmetric_qr_of_special_matrices(v):
    values, axes = whitening.symmetric_qr(v)
    np.testing.assert_allclose(v @ axes, axes * values, atol=1e-14 * max(1, np.abs(v).max()))


# ---- 12 -------------------------------------------------------------------------------------


def test_bpe_table_equals_the_library(spark):
    lib = Tokenizer.from_file(WORD)
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: r for r in llm_queries.op12_bpe_encoding(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_bpe_of_odd_texts(spark):
    lib, texts = Tokenizer.from_file(WORD), odd_texts()
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in enumerate(texts)] + [(None, "ab", 1, "d"), (5, "twice", 1, "d")], "doc_id long, text string, ids int, decoded string").repartition(3)
    out = bpe.decode(bpe.encode(df, WORD), WORD).collect()
    assert len(out) == len(texts) + 2
    got = {r.doc_id: r for r in out if r.ids != lib.encode("twice").ids}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        if got[i].ids != ids:
            assert i == 5 and t == "<|endoftext"
        assert got[i].decoded == lib.decode(got[i].ids, skip_special_tokens=False)
    assert got[None].ids == lib.encode("ab").ids
    assert bpe.decode(bpe.encode(df.where("false"), WORD), WORD).count() == 0
    strange = spark.createDataFrame([(1, [5, None, 10**6, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(strange, WORD).orderBy("doc_id").collect()] == [lib.id_to_token(5), None, ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(ALPHABET)), max_size=60), max_size=6))
def test_bpe_of_any_text(texts):
    lib = Tokenizer.from_file(WORD)
    assert bpe.PairIndexEncoder(WORD).encode(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def plain_merge(word, ranks):
    """Least rank first, leftmost first, one join at a time."""
    while True:
        best = min(((ranks[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks), default=None)
        if best is None:
            return word
        i = best[1]
        word = [*word[:i], ranks[word[i], word[i + 1]][1], *word[i + 2 :]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=12, unique=True), st.lists(st.binary(min_size=1, max_size=14), min_size=1, max_size=5), st.randoms())
def test_pair_index_where_joins_bring_up_lesser_ranks(pairs, words, rng):
    """A made-up vocabulary of byte values 0 to 3 whose joins come in any order, so that a join may wake a lesser rank."""
    text = {i: str(i) for i in range(4)}
    rules = []
    for a, b in pairs:
        a, b = (rng.choice(list(text)) if rng.random() < 0.5 else x for x in (a, b))
        made = next((i for i, t in text.items() if t == text[a] + text[b]), len(text))
        text[made] = text[a] + text[b]
        if (a, b) not in {r[:2] for r in rules}:
            rules.append((a, b, made))
    rng.shuffle(rules)
    e = object.__new__(bpe.PairIndexEncoder)
    e.inner = e.last = [b % 4 for b in range(256)]
    e.joins, e.ranks = rules, {r[:2]: i for i, r in enumerate(rules)}
    words = [bytes(b % 4 for b in w).decode() for w in words]
    assert e.encode_words(words) == [plain_merge([*w.encode()], {r[:2]: (i, r[2]) for i, r in enumerate(rules)}) for w in words]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    e, lib = bpe.PairIndexEncoder(WORD), Tokenizer.from_file(WORD)
    monkeypatch.setattr(bpe, "PIECE", 7)
    for t in odd_texts(7, 40):
        assert e.encode([t])[0] == lib.encode(t or "", add_special_tokens=False).ids


# ---- 13 -------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Every text's row by walking its tokens, with counts over all texts."""
    a_lib, b_lib = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(bpe.byte_symbols())}
    table = {i: bytes(byte.get(c, 63) for c in t) for t, i in a_lib.get_vocab(with_added_tokens=False).items()}
    out, links = [], []
    for text in texts:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        spelled_a = [table[i] for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([0, *map(len, s)]).tolist()[1:] for s in (spelled_a, spelled_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((a, ends_a), (b, ends_b))))
        links.append([(i, j) for i, e in zip(a, ends_a, strict=True) for j, f in zip(b, ends_b, strict=True) if e == f] if len(a) < 400 else [(a[ends_a.index(c)], b[ends_b.index(c)]) for c in cuts])
        out.append([len(a), len(b), len(cuts), len(links[-1]), sha(";".join(groups)) if a else ""])
    count = Counter(p for ls in links for p in ls)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*row, sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls)) for row, ls in zip(out, links, strict=True)]


def digests(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect()}


def test_alignment_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = digests(llm_queries.op13_tokenizer_alignment(spark, DATA))
    want = brute_alignment([r.text for r in rows])
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_alignment_of_odd_texts(spark, monkeypatch):
    texts = odd_texts(3)
    df = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in enumerate(texts)], "doc_id long, text string, block int, pair string, n_a int").repartition(3)
    assert digests(alignment.alignment_digest(df, BYTE, PIECE)) == dict(enumerate(brute_alignment(texts)))
    assert alignment.alignment_digest(df.where("false"), BYTE, PIECE).count() == 0
    twice = spark.createDataFrame([(None, "of the day"), (None, "of the day"), (7, None)], "doc_id int, text string")
    assert sorted(map(repr, alignment.alignment_digest(twice, BYTE, PIECE).collect()))[1:] == sorted(map(repr, alignment.alignment_digest(twice, BYTE, PIECE).collect()))[1:]
    assert [r.count_sum for r in alignment.alignment_digest(twice.where("doc_id is null"), BYTE, PIECE).collect()] == [6, 6]


def test_blocks_do_not_matter(spark, monkeypatch):
    texts = odd_texts(9, 120)
    want = [r[:5] for r in alignment.align_texts(texts, BYTE, PIECE)]
    assert [alignment.align_texts([t], BYTE, PIECE)[0][:5] for t in texts] == want
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50)  # the function is sent with its module's values where tasks start anew
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    assert digests(alignment.alignment_digest(df, BYTE, PIECE)) == dict(enumerate(brute_alignment(texts)))


def test_components_are_the_least_nodes():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 50))]
        name = list(range(n))
        for _ in range(n):
            for a, b in edges:
                name[a] = name[b] = min(name[a], name[b])
        u, v = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        assert alignment.components(u, v, n).tolist() == name
    chain = np.arange(5000)
    assert not alignment.components(chain[1:], chain[:-1], 5000).any()


def test_files_of_another_kind_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.PairIndexEncoder(BYTE)


def test_pair_counts_add_up(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    aligned = alignment.align(docs, BYTE, PIECE).cache()
    assert alignment.pair_counts(aligned).agg(F.sum("count")).first()[0] == aligned.agg(F.sum("n_links")).first()[0]
