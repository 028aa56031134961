"""Centroid clustering, product codes and token counts against plain versions, and their defined results in edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import bit_planes, product_codes, token_counts
from chronolake.llm.tokens import tokenizer_path

from .helpers import SCHEMA, corpus, rows

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance long, code string, _v string, _label string, n long"


def vectors(spark, given):
    """Rows of (id, vector, label), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, "x", "x", "x", 3) for i, v, label in given], VECTORS)


def nearest(v, entries):
    return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), k) for k, e in enumerate(entries))


def lloyd(points, entries, rounds):
    """The entries after ``rounds`` rounds of assignment and floored means, in Python integers."""
    entries = [list(e) for e in entries]
    for _ in range(rounds):
        own = [[] for _ in entries]
        for v in points:
            own[nearest(v, entries)[1]].append(v)
        entries = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else e for e, vs in zip(entries, own, strict=True)]
    return entries


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clusters(given, count, rounds, scale):
    points = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in given if usable(v) and len(v) == 64]
    first = sorted(points, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:count]
    centroids = lloyd([v for _, v in points], [v for _, v in first], rounds)
    placed = [(i, *nearest(v, centroids)[::-1]) for i, v in points]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, k, d, sum(e for _, j, e in placed if j == k), sum(e for *_, e in placed), digest[k])) for i, k, d in placed)


def product(given, parts, entries, rounds, scale):
    points = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in given if usable(v) and len(v) % parts == 0 and v]
    lengths = [len(v) for _, v, _ in points]
    most = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    points, own = [p for p in points if len(p[1]) == most], most // parts
    least = sorted(points, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[:entries]
    cut = lambda k: slice(own * k, own * (k + 1))
    books = [lloyd([v[cut(k)] for _, v, _ in points], [v[cut(k)] for _, v, _ in least], rounds) for k in range(parts)]
    found = [(i, [nearest(v[cut(k)], books[k]) for k in range(parts)], label) for i, v, label in points]
    coded = [(i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label) for i, best, label in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, code, e, sum(x for *_, x, lab in coded if lab == label), digest)) for i, code, e, label in coded)


def cloud(seed, n, length=64, spread=1.0):
    """Vectors around few middles, with copies, repeated ids, a null id, and everything that is dropped."""
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, spread) for _ in range(length)] for _ in range(5)]
    own = [(k * 7 % 101, [x + rnd.gauss(0, spread / 5) for x in rnd.choice(middles)], rnd.choice([None, 1, 2, 3])) for k in range(n)]
    own += [(200 + k, own[0][1], 1) for k in range(n // 3)] + [own[1], (own[1][0], own[2][1], 5), (None, own[3][1], None)]
    bad = [None, [], [1.0], [1.0] * (length + 1), [math.nan] + [0.0] * (length - 1), [math.inf] + [0.0] * (length - 1), [None] + [0.0] * (length - 1)]
    return own + [(300 + k, v, 1) for k, v in enumerate(bad)]


@pytest.mark.parametrize(("seed", "count", "scale", "spread"), [(1, 7, 256, 0.2), (2, 40, 256, 0.2), (3, 500, 16, 0.2), (4, 6, 256, 900.0)])
def test_clusters_by_brute_force(spark, seed, count, scale, spread):
    given = cloud(seed, 60, spread=spread)
    got = bit_planes.cluster(vectors(spark, given).repartition(5), count, 3, scale).collect()
    assert sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in got) == clusters(given, count, 3, scale)


@pytest.mark.parametrize("bits", [2, 9, 20, 28])
def test_planes_give_exact_dots(bits):
    rnd = np.random.default_rng(bits)
    a, b = (rnd.integers(-(1 << bits - 1), 1 << bits - 1, (n, 64)) for n in (30, 7))
    a[0], b[0] = -(1 << bits - 1), -(1 << bits - 1)
    left, right = bit_planes.pack(a, bits), bit_planes.pack(b, bits)
    assert (bit_planes.unpack(left) == a).all() and (bit_planes.dots(left, right) == b @ a.T).all() and (bit_planes.norms(left) == (a * a).sum(1)).all()
    assert [bit_planes.planes_needed(x, y) for x, y in ((0, 0), (-1, 0), (0, 1), (-2, 1), (-3, 0))] == [1, 1, 2, 2, 3]


def test_clusters_of_nothing_and_of_too_much(spark):
    assert bit_planes.cluster(vectors(spark, [])).count() == bit_planes.cluster(vectors(spark, [(1, None, 1)])).count() == 0
    one = bit_planes.cluster(vectors(spark, [(5, [0.0] * 64, 1)] * 3)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(5, 0, 0, 0)] * 3
    with pytest.raises(ValueError):
        bit_planes.cluster(vectors(spark, [(5, [1e300] * 64, 1)]))


@pytest.mark.parametrize(("seed", "length", "entries", "scale", "spread"), [(1, 64, 16, 1024, 0.2), (2, 8, 256, 1024, 0.2), (3, 12, 5, 1 << 20, 20.0), (4, 4, 1, 1024, 0.2)])
def test_codes_by_brute_force(spark, seed, length, entries, scale, spread):
    given = cloud(seed, 50, length, spread)
    got = product_codes.codes(vectors(spark, given).repartition(5), 4, entries, 3, scale).collect()
    assert sorted(str(tuple(r)) for r in got) == product(given, 4, entries, 3, scale)


@pytest.mark.parametrize("bits", [3, 24, 27, 29])
def test_limbs_give_exact_products(bits):
    rnd = np.random.default_rng(bits)
    a, b = (rnd.integers(-(1 << bits), (1 << bits) + 1, (n, 16)) for n in (40, 9))
    a[0], a[1], b[0], b[1] = -(1 << bits), 1 << bits, -(1 << bits), 1 << bits
    width = product_codes.limb_bits(16)
    assert 16 << (2 * width) <= 1 << 53 < 16 << (2 * width + 2)
    assert (len(product_codes.limbs(a, width)) > 1) == (bits >= width)
    assert product_codes.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_codes_of_nothing_and_of_too_much(spark):
    assert product_codes.codes(vectors(spark, [])).count() == product_codes.codes(vectors(spark, [(1, None, 1), (2, [1.0] * 3, 1)])).count() == 0
    with pytest.raises(ValueError):
        product_codes.codes(vectors(spark, [(5, [1e300] * 64, 1)]))
    with pytest.raises(ValueError):
        product_codes.codes(vectors(spark, []), entries=257)


STRANGE = [
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> < |endoftext|>", "it's IT'S we're 'll ''s", "1234 5.6e-7 x1y2", "é é ẞ İstanbul ΣΣ Σ",
    "a b c d\x0be\x0cf\x1cg\x85h", "你好，世界 \U0001f600\U0001f468‍\U0001f469", "\u0000 � \x7f", " ́x", "....!!!???", "x" * 5000, "word" * 9 + "." * 41, "\r\n\t \t", "ﬁ ſ Å",
]


@pytest.mark.parametrize("held", [token_counts.HELD, 40, 0])
def test_counts_equal_the_librarys(spark, held, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "COUNTED", 50)
    whole = Tokenizer.from_file(tokenizer_path())
    docs = [*corpus(3), *((1000 + k, t) for k, t in enumerate(STRANGE)), (2000, " ".join(STRANGE) * 30), (7, "#!?"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows(docs), SCHEMA).select("doc_id", "text", "lang", *(F.lit("x").alias(c) for c in ("row", "n", "pre_token", "pieces", "documents", "n_bytes", "n_tokens")))
    got = token_counts.count_tokens(df, 100, held=held).collect()
    expected = [(d, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t in docs]
    assert sorted(str(tuple(r)) for r in got) == sorted(str((d, b, n, n > 100)) for d, b, n in expected)


def test_each_pre_token_is_measured_once(spark):
    docs = spark.createDataFrame(rows([(1, "One two, two"), (2, "two<|endoftext|>"), (3, None)]), SCHEMA)
    got = sorted(tuple(r) for r in token_counts.pieces_table(docs).collect())
    assert [(t, n) for t, n, _ in got] == sorted([(",", 1), ("one", 1), ("two", 3), (token_counts.SPECIAL + "<|endoftext|>", 1)]) and all(p == 1 for *_, p in got)


def test_shortcut_equals_the_library():
    table = token_counts.pre_tokens(None)
    assert table.shortcut
    rnd = random.Random(5)
    letters = "abzAZéÉßÿÀÖØöø" + "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(3000)} | {a + b for a in ("Wort", "É") for b in letters}
    for w in words:
        assert table[w] == tuple(table.plain(w)), w


def test_frequent_pre_tokens_are_bounded(spark):
    table = spark.createDataFrame([(f"t{k}", 1 + k // 4, k) for k in range(400)] + [("l" * 65, 10**6, 1)], "pre_token string, times long, pieces long")
    for most in (0, 3, 50, 399, 400, 10**6):
        got = token_counts.most_frequent(table, most)
        assert len(got) <= most and (most < 50 or len(got) > most // 3 or most > 400)
        if got:
            least = min(1 + int(t[1:]) // 4 for t in got)
            assert all((f"t{k}" in got) == (1 + k // 4 >= least) for k in range(400))
    assert len(token_counts.most_frequent(table, 400)) == 400


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in token_counts.count_tokens(spark.createDataFrame(rows([(1, None), (2, "")]), SCHEMA)).orderBy("doc_id").collect()] == [(1, 0, 0, False), (2, 0, 0, False)]


def test_registered_token_counts(spark):
    from tokenizers import Tokenizer

    from chronolake.llm.queries import op13_token_counts

    d = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(tokenizer_path())
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, len((r.text or "").encode()), n := len(whole.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in texts)
    assert sorted(tuple(r) for r in op13_token_counts(spark, d).collect()) == expected
