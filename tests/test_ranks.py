"""Exact percentiles and candidate texts: brute force, and what their plans must not hold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronolake.operators import candidates, ranks
from chronolake.plans import catalog

SF = "/root/testdata/sf0.001"


def values(seed):
    rnd, inf = random.Random(seed), math.inf
    rows = [("a", rnd.gauss(0, 1)) for _ in range(300)] + [("b", float(rnd.randrange(3))) for _ in range(200)] + [(None, 10.0 ** rnd.randint(-300, 300) * rnd.choice([1, -1])) for _ in range(100)]
    rows += [("c", 7.0), ("d", None), ("e", float("nan")), ("e", 2.0)] + [("f", x) for x in (inf, -inf, 1.0, 2.0, 3.0, 1e308, -1e308)] + [("g", 5.0)] * 90 + [("h", 1 + k * 2.0**-52) for k in range(40)]
    by = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    return rows, {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize(("bins", "most"), [(64, 3), (1024, 50), (1024, 20_000)])
def test_order_statistics(spark, bins, most):
    rows, by = values(bins + most)
    asked = {f"r{i}": (lambda n, i=i: F.floor(n * i / 7)) for i in range(7)} | {"top": lambda n: n - 1, "beyond": lambda n: n}
    got = {r.k: r for r in ranks.order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", asked, bins, most).collect()}
    assert set(got) == set(by)
    for k, own in by.items():
        assert (got[k].n, got[k].top, got[k].beyond) == (len(own), own[-1], None)
        assert [got[k][f"r{i}"] for i in range(7)] == [own[len(own) * i // 7] for i in range(7)], k


def test_statistics_of_whole_numbers_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 2**62 + k, k % 2) for k in range(50)] + [("a", -(2**62), 0)], "k string, v long, j int")
    got = {r.j: r for r in ranks.order_statistics(df, ["k", "j"], "v", {"low": lambda n: n * 0, "mid": ranks.nearest_rank(0.5)}, 8, 2).collect()}
    assert (got[0].low, got[0].mid, got[1].low, got[1].mid) == (-(2**62), 2**62 + 22, 2**62 + 1, 2**62 + 25)
    assert ranks.order_statistics(df.where("false"), ["k"], "v", {"low": lambda n: n * 0}).count() == 0


@pytest.mark.parametrize("most", [2, 1000])
def test_percentiles_are_linear(spark, most):
    own = sorted(random.Random(4).random() for _ in range(101))
    r = ranks.percentiles(spark.createDataFrame([("a", x) for x in own], "k string, v double"), ["k"], "v", {"p10": 0.1, "p33": 0.333, "p100": 1.0}, most=most).first()
    assert (r.p10, r.p100) == (own[10], own[100]) and abs(r.p33 - (own[33] + 0.3 * (own[34] - own[33]))) < 1e-12


def test_percentile_plans(spark, capsys):
    for name in ("a7_ratio_stats", "a9_numeric_deltas", "a10_value_transitions", "a25_fold_report"):
        catalog.QUERIES[name](spark, SF).explain()
        plan = capsys.readouterr().out
        assert "percentile(" not in plan and "median(" not in plan and "hashpartitioning(column" not in plan.split("Window")[-1].split("\n")[0], name
        assert all("_lo" in line for line in plan.split("\n") if "Window [row_number" in line), plan


TERMS = [("000007.SZ", ["Acme", " ring ", "", None]), ("8.HK", ["é", "ab", "acme corp"]), ("9", None), (None, ["lost"]), ("600000.SH", ["RING", "zzzz", "a.b"])]


def linked(titles):
    out = set()
    for code, names in TERMS:
        if code is None:
            continue
        terms = {code, *([code.split(".")[0]] if "." in code else []), *(n.strip() for n in names or [] if n and n.strip())}
        out |= {(code, i) for i, own, title in titles if own == code or any(t.lower() in (title or "").lower() for t in terms)}
    return out


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_candidates_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(candidates, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(2)
    words = ["ACME", "corp", "rings", "Éa", "ab", "9", "xb", "a.b", "axb", "000007", "8.HK", "zzz", "Acme corp", "spring"]
    titles = [(k, rnd.choice(["9", "8.HK", "x", None]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))) for k in range(120)] + [(500, None, None), (501, "600000.SH", None), (502, "x", "ri"), (503, "x", "lost")]
    index = spark.createDataFrame(titles, "text_id int, ts_code string, title string")
    companies = spark.createDataFrame(TERMS, "code string, terms array<string>")
    got = [tuple(r) for r in candidates.candidate_rows(index, companies).collect()]
    assert len(got) == len(set(got)) and set(got) == linked(titles)
    assert candidates.candidate_rows(index, companies.where("false")).count() == 0 == candidates.candidate_rows(index.where("false"), companies).count()


def test_candidates_need_no_nested_loop(spark, capsys):
    catalog.QUERIES["j17_candidate_rows"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "contains" in plan
