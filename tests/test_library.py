"""Search in a laid-out text library: bounds of patterns, reads of bodies, order and visibility."""

import random
import re
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.operators import library


def test_literals_of_patterns():
    assert library.literals("licen[cs]e") == [["licen"]]
    assert library.literals("abcd|Wxyz") == [["abcd"], ["wxyz"]]
    assert library.literals("(abc|def)+ghij") == [["abc", "ghij"], ["def", "ghij"]]
    assert library.literals("中文字.*end") == [["中文字", "end"]]
    for unbounded in ("ab", "a.b.c", "abcd|x", "(abcd)?", "[a-z]{5}", "ÉÀÈ"):
        assert library.literals(unbounded) == []


TEXTS = [(1, "own thing", 5, "c.SZ", "nothing"), (2, "thing", 9, "x.SZ", "hidden"), (3, "other", 3, "x.SZ", "so many words before a Thing and after"), (4, "other", 4, "c.SZ", None), (5, None, 6, None, "THING " * 3), (6, "thin", 6, "c.SZ", "thi hin ing"), (7, "thing", None, "c.SZ", "thing")]
SCHEMA = "text_id long, title string, available_at int, ts_code string, body string"


@pytest.fixture(scope="module")
def lib(spark):
    return library.build(spark, spark.createDataFrame(TEXTS, SCHEMA), tempfile.mkdtemp(prefix="spark-") + "/lib", 2, 2)


def test_order_visibility_and_snippets(spark, lib):
    out = library.search(spark, lib, "thing", F.lit(6), 10, snippet=7, around=4).collect()
    assert [(r.text_id, r.rank, r.snippet, r.context) for r in out] == [(1, 20, "nothing", "nothin"), (5, 10, "THING T", "THIN"), (3, 10, "so many", "e a Thin")]
    assert [r.text_id for r in library.search(spark, lib, "thing", F.lit(6), 2).collect()] == [1, 5]
    assert [r.text_id for r in library.search(spark, lib, "thing", F.lit(6), 9, in_bodies=False).collect()] == [1]
    assert [r.text_id for r in library.search(spark, lib, r"^c\.sz", F.lit(6), 9).collect()] == [6, 1, 4]


def test_company_and_window(spark, lib):
    out = library.search(spark, lib, "thing|hin", F.lit(6), 9, ("c.SZ", ["other"]), F.lit(4)).collect()
    assert [(r.text_id, r.rank, r.relevance) for r in out] == [(6, 40, "candidate"), (1, 40, "candidate")]
    assert [(r.text_id, r.rank) for r in library.search(spark, lib, "before a", F.lit(6), 9, ("c.SZ", ["other"])).collect()] == [(3, 30)]
    assert library.search(spark, lib, "thing", F.lit(6), 9, ("nobody", [])).collect() == []


@pytest.mark.parametrize("pattern", ["thing", "th.ng", "many|hidden", "(so|an) m?", "a t", "x*", "words.{1,9}thing", "zzz"])
def test_the_bound_loses_nothing(spark, lib, pattern):
    bound = library.posting_hits(spark, lib, pattern)
    have = None if bound is None else {r.text_id for r in bound.collect()}
    matches = {i for i, _, _, _, body in TEXTS if body is not None and re.search(pattern, body, re.I)}
    assert have is None or matches <= have
    shown = {r.text_id for r in library.search(spark, lib, pattern, F.lit(99), 99).collect()}
    assert shown == {i for i, title, at, code, body in TEXTS if at is not None and any(x is not None and re.search(pattern, x, re.I) for x in (title, code, body))}


def test_only_buckets_of_the_pattern_are_read(spark, lib):
    plan = library.posting_hits(spark, lib, "thing")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(gram", plan)


def test_empty_library(spark):
    empty = library.build(spark, spark.createDataFrame([], SCHEMA), tempfile.mkdtemp(prefix="spark-") + "/lib")
    assert library.search(spark, empty, "thing", F.lit(6), 5).collect() == []


@pytest.mark.parametrize(("texts", "chars"), [(4096, 4_000_000), (3, 4_000_000), (4096, 7)])
def test_lists_of_grams(spark, tmp_path, monkeypatch, texts, chars):
    rnd = random.Random(texts + chars)
    bodies = ["".join(rnd.choice("abÀ中\U0001f600 ") for _ in range(rnd.randrange(12))) for _ in range(60)] + ["", "ab", None]
    monkeypatch.setattr(library, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(library, "BLOCK_CHARS", chars)
    own = [(i, b.lower()) for i, b in enumerate(bodies) if b is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([b for _, b in own], pa.string())], ["text_id", "body"])
    got = [(g, i) for out in library._post(iter([batch])) for g, ids in zip(*(c.to_pylist() for c in out.columns), strict=True) for i in ids]
    want = {(b[k : k + 3], i) for i, b in own for k in range(len(b) - 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_more_characters_than_a_number_holds():
    wide = ["".join(map(chr, range(0x10000, 0x10000 + 900_000))), "abc"] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(wide)], ["text_id", "body"])
    found = {}
    for out in library._post(iter([batch])):
        for g, ids in zip(*(c.to_pylist() for c in out.columns), strict=True):
            found.setdefault(g, []).extend(ids)
    assert len(found) == 899_999 and found["abc"] == [1, 3] and found[wide[0][:3]] == [0, 2]


def test_no_gram_of_a_text_is_shuffled(spark, lib):
    assert dict(spark.read.parquet(lib.grams).dtypes)["ids"] == "array<bigint>"  # a row a gram and block, not a row a gram and text
    lists = spark.read.parquet(lib.grams).where("gram = 'thi'")
    assert sorted(i for r in lists.collect() for i in r.ids) == [1, 3, 5, 6, 7] and lists.count() < 4
