"""Generations of published tables: stamps, damage, interruptions, releases, guards; ledgers and compaction."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from chronolake.sources import lake, publish

SCHEMA = "p string, q int, id long, v double, w string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


A = [("x", 1, 1, 1.5, None), ("x", 1, 2, None, "é"), ("x", 2, 3, 0.1, ""), (None, 1, 4, 2.0, "a"), ("y", None, 5, 3.0, "b"), ("y", None, 5, 3.0, "b")]
B = [("x", 1, 1, 1.5, None), ("x", 1, 2, None, "é"), ("x", 2, 3, 0.2, ""), (None, 1, 4, 2.0, "a"), ("z/=1", 7, 6, 3.0, None)]
PARTS = ["p", "q"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stamps(spark, root):
    return {r.part: r.available_at for r in publish.manifest(spark, root).collect()}


def files(root, text):
    return [f for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True) if text in f]


def test_two_generations(spark, tmp_path):
    root = str(tmp_path / "r")
    assert publish.manifest(spark, root).count() == 0
    assert publish.publish(spark, root, {"t": (frame(spark, A), PARTS), "one": (frame(spark, A), [])}, "t1") == 1
    assert rows(publish.read(spark, root, "t").select("p", "q", "id", "v", "w")) == sorted(A, key=str) == rows(publish.read(spark, root, "one"))
    kept = files(root, "q=1")
    assert publish.publish(spark, root, {"t": (frame(spark, B), PARTS)}, "t2") == 2
    assert rows(publish.read(spark, root, "t").select("p", "q", "id", "v", "w")) == sorted(B, key=str)
    assert {(p, at) for p, at in stamps(spark, root).items()} == {("p=x/q=1", "t1"), ("p=x/q=2", "t2"), ("p=null/q=1", "t1"), ("p=z/=1/q=7", "t2"), ("all", "t1")}
    assert files(root, "q=1") == kept  # equal content is not written again
    assert rows(publish.read(spark, root, "t", generation=1).select("p", "q", "id", "v", "w")) == sorted(A, key=str)
    assert publish.publish(spark, root, {"t": (frame(spark, B).repartition(5), PARTS)}, "t3") == 3
    assert "t3" not in stamps(spark, root).values()
    publish.publish(spark, root, {"t": (frame(spark, [("x", 2, 9, 9.0, "n")]), PARTS)}, "t4", replace=False)
    assert rows(publish.read(spark, root, "t").select("id")) == [(1,), (2,), (4,), (6,), (9,)] and stamps(spark, root)["p=x/q=2"] == "t4"
    publish.publish(spark, root, {"t": (frame(spark, []), PARTS)}, "t5")
    assert "all" in stamps(spark, root) and len(stamps(spark, root)) == 1


@pytest.mark.parametrize("damage", ["changed", "missing", "unlisted", "folder"])
def test_damage_is_refused(spark, tmp_path, damage):
    root = str(tmp_path / "r")
    publish.publish(spark, root, {"t": (frame(spark, A), PARTS)}, "t1")
    folder = os.path.dirname(files(root, "p=x/q=2")[0])
    base = os.path.dirname(os.path.dirname(folder))
    if damage == "changed":
        shutil.rmtree(folder)
        spark.createDataFrame([(3, 0.25, "")], "id long, v double, w string").write.parquet(folder)
    elif damage == "missing":
        shutil.rmtree(folder)
    elif damage == "unlisted":
        spark.createDataFrame([(3, 0.1, "")], "id long, v double, w string").write.parquet(f"{base}/p=new/q=1")
    else:
        shutil.rmtree(base)
    states = {r.part: r.state for r in publish.verify(spark, root, "t").collect()}
    assert states[{"unlisted": "p=new/q=1"}.get(damage, "p=x/q=2")] == {"folder": "missing"}.get(damage, damage)
    assert damage == "folder" or [s for s in states.values() if s != "ok"] == [damage]
    for refused in (lambda: publish.read(spark, root, "t"), lambda: publish.freeze(spark, root, "r1", ["t"])):
        with pytest.raises(publish.Damaged):
            refused()
    with pytest.raises(publish.Damaged):
        publish.read(spark, root, "absent")


def test_an_interrupted_publish_is_not_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    publish.publish(spark, root, {"t": (frame(spark, A), PARTS)}, "t1")
    state = []
    whole = publish._digests
    monkeypatch.setattr(publish, "_digests", lambda df, columns, *more: whole(df, columns, *more) if not state and not state.append(1) else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        publish.publish(spark, root, {"t": (frame(spark, B), PARTS)}, "t2")
    monkeypatch.undo()
    assert len(files(root, "q=2")) == 2  # staged and not published
    assert rows(publish.read(spark, root, "t").select("id")) == rows(frame(spark, A).select("id")) and set(stamps(spark, root).values()) == {"t1"}
    assert publish.publish(spark, root, {"t": (frame(spark, B), PARTS)}, "t3") == 2


def test_releases(spark, tmp_path):
    root = str(tmp_path / "r")
    publish.publish(spark, root, {"t": (frame(spark, A), PARTS), "u": (frame(spark, A), ["p"]), "none": (frame(spark, []), [])}, "t1")
    with pytest.raises(publish.Damaged, match="lacks none, other"):
        publish.freeze(spark, root, "r1", ["t", "none", "other"])
    own = publish.freeze(spark, root, "r1", ["t", "u"])
    publish.publish(spark, root, {"t": (frame(spark, B), PARTS)}, "t2")
    shutil.rmtree(f"{root}/data")
    assert publish.freeze(spark, root, "r1", ["t"]) == own
    assert rows(publish.read(spark, own, "t").select("p", "q", "id", "v", "w")) == sorted(A, key=str) and set(stamps(spark, own).values()) == {"t1"}
    with pytest.raises(publish.Damaged, match="lacks other"):
        publish.freeze(spark, root, "r1", ["other"])


def test_guards_part_by_part(spark, tmp_path):
    root, schema = str(tmp_path / "r"), "part int, id long"
    old = [(p, k) for p in range(4) for k in range(100)]
    new = [(0, k) for k in range(60)] + [(1, k) for k in range(95)] + [(1, 0)] + [(3, k) for k in range(100)] + [(4, 1)]
    publish.publish(spark, root, {"t": (spark.createDataFrame(old, schema), ["part"])}, "t1")
    got = {r.part: (r.old_keys, r.new_rows, r.removed, r.action) for r in publish.replace_guarded(spark, root, "t", spark.createDataFrame(new, schema), "part", ["id"], "t2").collect()}
    assert got == {0: (100, 60, 40, "block"), 1: (100, 96, 5, "overwrite"), 2: (100, 0, 100, "skip_empty"), 3: (100, 100, 0, "overwrite"), 4: (0, 1, 0, "overwrite")}
    counts = {r.part: r["count"] for r in publish.read(spark, root, "t").groupBy("part").count().collect()}
    assert counts == {0: 100, 1: 96, 2: 100, 3: 100, 4: 1}
    assert stamps(spark, root) == {"part=0": "t1", "part=1": "t2", "part=2": "t1", "part=3": "t1", "part=4": "t2"}
    strict = publish.replace_guarded(spark, root, "t", spark.createDataFrame([(1, 1)], schema), "part", ["id"], "t3", allow_removal=False)
    assert {r.part: r.action for r in strict.collect()} == {0: "skip_empty", 1: "skip_removed", 2: "skip_empty", 3: "skip_empty", 4: "skip_empty"}


def test_ledger_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "l")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert [lake.append_records(spark, path, df, ["id"]) for df in (first, first, spark.createDataFrame([(2, "z"), (3, "d")], first.schema))] == [2, 0, 1]
    assert rows(spark.read.schema(first.schema).json(path)) == [(1, "a"), (2, "b"), (3, "d")]


def test_compaction_splits_and_validates(spark, tmp_path):
    path = str(tmp_path / "c")
    ticks = spark.range(40_000).select(F.lit("d1").alias("day"), F.col("id").cast("string").alias("code"), F.rand(1).alias("v")).unionByName(spark.createDataFrame([("d2", "1", 1.0), ("d2", "1", 2.0)], "day string, code string, v double"))
    expected = spark.createDataFrame([("d1", "5"), ("d2", "1"), ("d2", "9")], "day string, code string")
    with pytest.raises(ValueError, match="d2, 9"):
        lake.compact_by_date(ticks, path, "day", ["code"], expected)
    assert not os.path.exists(path)
    # Small data as if it were large: several tasks before the rebalance, and a low size to aim at.
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        lake.compact_by_date(ticks, path, "day", ["code"], expected.where("code <> '9'"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = glob.glob(f"{path}/day=d1/*.parquet")
    assert len(parts) > 1 and spark.read.parquet(path).count() == 40_001
    for f in parts:
        codes = [r.code for r in spark.read.parquet(f).collect()]
        assert codes == sorted(codes)


def test_profile_reads_footers_only(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(F.col("id").alias("n"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 400).alias("day"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"), F.lit("wide").alias("body"))
    df.repartition(3).write.parquet(path)
    found = lake.metadata_profile(spark, path, ["n", "day"], ["k", "n"])
    assert tuple(found.first()) == tuple(lake.footer_profile(df, ["n", "day"], ["k", "n"]).first())
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedAggregation" in plan and "COUNT(*)" in plan and "MIN(day)" in plan and "body" not in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_a_frame_is_worked_out_once(spark, tmp_path):
    root = str(tmp_path / "r")
    chance = F.udf(lambda i: random.SystemRandom().random(), "double").asNondeterministic()
    publish.publish(spark, root, {"t": (spark.range(20).select((F.col("id") % 3).alias("p"), chance("id").alias("v")), ["p"])}, "t1")
    assert publish.read(spark, root, "t").count() == 20
