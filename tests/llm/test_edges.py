"""Edge cases and brute-force versions: rows without own ids, many blocks, budgets, disclosure, and the pipeline as a whole."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import chat, common
from chronolake.llm import components as components_module
from chronolake.llm import decontaminate, imatch, jaccard, langid, pack, pii, substring, token_file, toxicity
from chronolake.llm.components import components

from .helpers import corpus
from .test_operators import frame, groups10, removed, spans3, words1

# 2 chat


def test_windows_are_within_budget(spark):
    say = lambda n: " ".join(["w"] * n)
    turns = {1: [("user", 500), ("assistant", 1900)], 2: [("system", 1500), *[("user", 300), ("assistant", 200)] * 4], 3: [("user", 760), ("assistant", 760), ("user", 30)], 4: [("system", 2300), ("user", 10)], 5: [("system", 5)], 6: [("user", 1019)] * 2, 7: [("user", 5000), ("assistant", 3)]}
    given = [(c, t, role, say(n)) for c, own in turns.items() for t, (role, n) in enumerate(own)]
    given += [(8, t % 3, ["user", "assistant"][t % 2], say(t % 40)) for t in range(700)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    out = chat.windows(df).collect()
    for r in out:
        alone = r.text.count("<|im_start|>") == 1
        assert r.tokens <= chat.BUDGET or alone, (r.conv_id, r.window, r.tokens)
    by = Counter(r.conv_id for r in out)
    assert by[3] == 2 and by[5] == 1 and by[4] == 2
    two = [r for r in out if r.conv_id == 3]
    assert max(r.text.count("<|im_start|>") for r in two) >= 2
    assert chat.read_back(chat.windows(df)).count() == len({c for c, *_ in given})


# 3 personal data by brute force


def free_words(text, spans):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]


def pii_by_hand(texts):
    """All spans of each text: base kinds, and the terms whose share of an entity's information reaches the limits."""
    base = [spans3(t or "") for t in texts]
    words = [{w for w, _, _ in free_words(t or "", s)} for t, s in zip(texts, base, strict=True)]
    held = [{e for k, a, b in s for e in (k, f"{k}:{t[a:b]}")} for t, s in zip(texts, base, strict=True)]
    n, n_e, n_both = Counter(w for ws in words for w in ws), Counter(e for es in held for e in es), Counter((e, w) for es, ws in zip(held, words, strict=True) for e in es for w in ws)
    kind, alone = {}, {}
    for (e, w), both in n_both.items():
        p, z = both / n[w], pii.Z
        low = (p + z * z / 2 / n[w] - z * math.sqrt(p * (1 - p) / n[w] + z * z / 4 / n[w] / n[w])) / (1 + z * z / n[w])
        share, sure = (math.log2(x * len(texts) / n_e[e]) / max(math.log2(len(texts) / n_e[e]), 1e-9) for x in (p if both >= pii.SUPPORT else low, low))
        if share >= pii.GENERALISE:
            kind[e, w] = "remove" if share >= pii.REMOVE else "generalise"
            if sure >= pii.REMOVE and ":" in e:
                alone[w] = max(alone.get(w, ""), kind[e, w])
    out, order = [], (*pii.KINDS, "generalise", "remove")
    for t, s, es in zip(texts, base, held, strict=True):
        more = []
        for w, a, b in free_words(t or "", s):
            k = max([alone.get(w, ""), *(kind.get((e, w), "") for e in es)])
            if k:
                more.append((k, a, b))
        out.append(sorted(s + more, key=lambda x: (order.index(x[0]), x[1], x[2])))
    return out


def private_corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "ta") for b in ("n", "st", "ra", "do", "qu")]
    out = []
    for k in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 60))] + [f"rare{rnd.randrange(200)}"]
        if k % 9 == 0:
            body += ["zorblax", *[rnd.choice(words)] * 8, "joe@x.org"]
        if k % 40 == 1:
            body += ["Zorblax"]
        if k % 13 == 0:
            body += [f"10.0.{k % 3}.{k % 7}", "+1 555 0100 222", "server"]
        rnd.shuffle(body)
        out.append(" ".join(body))
    out += [f"quuxly {rnd.choice(words)} ann@y.org" for _ in range(30)] + ["here is quuxly again"] + [" ".join(rnd.choice(words) for _ in range(9)) for _ in range(6 * n)]
    return [*out, None, "", out[0], "é@x.y 1.1.1.1 " * 30]


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_by_brute_force(spark, seed):
    texts = private_corpus(seed)
    expected = [",".join(f"{k}:{a}:{b}" for k, a, b in own) for own in pii_by_hand(texts)]
    found = {r.doc_id: r for r in pii.report(frame(spark, list(enumerate(texts)))).collect()}
    assert [found[k].spans for k in range(len(texts))] == expected
    assert any("remove" in e and "email" not in e for e in expected)  # a term alone, in a text without the address
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, list(enumerate(texts)))).collect()}
    assert [clean[k] for k in range(len(texts))] == [t if t is None else pii.replaced(t, own) for t, own in zip(texts, pii_by_hand(texts), strict=True)]


def test_plain_texts_are_read_once(spark, tmp_path):
    texts = private_corpus(3, 30)
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for out in (pii.report(docs), pii.sanitise(docs)):
        assert not any(str(tmp_path) in f for f in out.inputFiles())  # texts without spans were searched again for the last step
        assert out.count() == len(texts)
    rnd = random.Random(4)
    signs = "aZ9_ -.\u00b5\u0130\u03a3\u03c2\u00df\u0301\u2028\u4e2d\u0663\u00b2\x1c"
    for text in ("".join(rnd.choices(signs, k=rnd.randint(0, 20))) for _ in range(2000)):
        assert pii._words(text) == {w.lower() for w in pii._WORD.findall(text)}


def test_any_column_names(spark):
    names = "_doc, _spans, _slot, _key, _own, _terms, _bad, _dropped, k, o, q, b, c0"
    docs = [(k, t) for k, t in enumerate([*private_corpus(3, 30), "a b c d e f g", "a b c d e f g"])]
    df = frame(spark, docs).select("doc_id", "text", *(F.lit("x").alias(c.strip()) for c in names.split(",")))
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (pii.sanitise(df), jaccard.keep_one(df), decontaminate.drop_contaminated(df, bench), langid.keep_identified(df, {})):
        assert out.columns == df.columns and out.count() > 0
    assert substring.dedup(df).count() == len(docs) == pii.report(df).count() and pack.pack(df).count() >= len(docs)


def test_no_rows(spark):
    none = frame(spark, [])
    assert pii.report(none).count() == 0 and langid.identify(none, langid.train(none)).count() == 0 and langid.keep_identified(none, {}).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_long_texts(spark):
    text = "word joe@x.org 10.0.0.1 " * 3000
    r = pii.report(frame(spark, [(1, text), (2, "x")])).orderBy("doc_id").first()
    assert (r.n_email, r.n_ip) == (3000, 3000)


# 4 substring dedup


def test_substrings_without_copies_and_with_repeated_ids(spark):
    rnd = random.Random(5)
    own = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = own(140), own(140)
    for docs in ([(1, a), (2, b)], [(1, "short"), (2, "text"), (3, None)], [(1, a), (2, a[:80]), (3, a)]):
        got = {r.doc_id: tuple(r)[1:5] for r in substring.dedup(frame(spark, docs)).collect()}
        assert got == removed(docs)
    docs = [(1, a), (2, a + b), (2, b + own(60)), (None, a), (None, b), (2, a + b)]
    got = substring.dedup(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    # Null ids are the least; rows of one id take nothing from each other.
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted([(1, 140, 140), (2, 280, 280), (2, 200, 140), (0, 140, 0), (0, 140, 0), (2, 280, 280)])


def test_anchor_with_many_surroundings(spark):
    rnd = random.Random(6)
    core = "the one passage that all have"
    sides = ["".join(rnd.choice("abcdefghij") for _ in range(25)) for _ in range(12)]
    docs = [(k, rnd.choice(sides) + core + rnd.choice(sides) + str(k)) for k in range(120)]
    assert {r.doc_id: tuple(r)[1:5] for r in substring.dedup(frame(spark, docs)).collect()} == removed(docs)


def test_registered_substring_query(spark):
    from chronolake.llm.queries import op4_substring_dedup

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_substring_dedup(spark, d).collect()}
    assert got == removed(docs)


# 6 token files


def test_ids_beyond_the_vocabulary_are_refused():
    with pytest.raises(ValueError):
        token_file.encode(np.array([5, token_file.VOCABULARY]))


# 7 fingerprints


def test_fingerprints_in_many_blocks(spark):
    docs = [(k * 7 % 1000, f"text {k} ka lo mi") for k in range(120)]
    few = {r.doc_id: tuple(r) for r in imatch.fingerprints(frame(spark, docs)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1500")
    try:
        plan = imatch.with_next(frame(spark, docs))
        nexts = {r.doc_id: r.next_text for r in plan.coalesce(8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(docs)
    assert nexts == {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)} and len(few) == len(docs)


def test_fingerprints_by_brute_force(spark):
    docs = list(enumerate(private_corpus(8)))
    terms = {d: set(re.findall(r"[^\W_]+", (t or "").lower())) for d, t in docs}
    n = Counter(w for ws in terms.values() for w in ws)
    lexicon = {w for w, c in n.items() if imatch.RARE * len(docs) <= c <= imatch.COMMON * len(docs)}
    found = {r.doc_id: r for r in imatch.fingerprints(frame(spark, docs)).collect()}
    prints = defaultdict(set)
    for d, t in docs:
        own = frozenset(terms[d] & lexicon)
        prints[own if own else ("text", t or "")].add(found[d].fingerprint)
    assert len(lexicon) > 3 and all(len(v) == 1 for v in prints.values())
    assert len({next(iter(v)) for v in prints.values()}) == len(prints)
    order = sorted(docs)
    for i, (d, _) in enumerate(order):
        a, b = found[d].fingerprint, found[order[(i + 1) % len(order)][0]].fingerprint
        if len(a) == len(b) == 6 * imatch.LEXICONS:
            parts = [(a[6 * k : 6 * k + 6], b[6 * k : 6 * k + 6]) for k in range(imatch.LEXICONS)]
            held = [(x, y) for x, y in parts if (x, y) != (imatch.NO_TERMS, imatch.NO_TERMS)]
            assert abs(found[d].near_next - sum(x == y for x, y in held) / max(len(held), 1)) < 1e-9


# 9 toxicity


def test_held_out_toxicity(spark):
    from chronolake.llm.queries import op9_toxicity

    d = "/root/testdata/sf0.1"
    held = op9_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    said, toxic = sum(r.predicted for r in held), sum(r.toxic for r in held)
    right = sum(r.predicted * r.toxic for r in held)
    assert toxic > 20 and right >= 0.75 * toxic and right >= 0.9 * said


# 10 Jaccard join


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard.join(frame(spark, corpus(1, 5)), 3, 1, 3)


@pytest.mark.parametrize(("num", "den"), [(51, 100), (1, 1)])
def test_join_at_other_similarities(spark, num, den):
    docs = corpus(13, 50)
    out = jaccard.join(frame(spark, docs), 3, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == groups10(docs, 3, num, den)


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = [(None, a), (None, b), (5, a), (5, b), (7, b + " x"), (9, "other words only here")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.join(frame(spark, docs)).collect())
    assert got == sorted([("None", "None"), ("None", "None"), ("5", "None"), ("5", "None"), ("7", "None"), ("9", "9")])
    kept = sorted(str(r.doc_id) for r in jaccard.keep_one(frame(spark, docs)).collect())
    assert kept == ["9", "None", "None"]


# The pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(3)
    item = " ".join(f"bench{k}" for k in range(14))
    docs = [(d, t) for d, t in corpus(12)]
    docs += [(500 + k, t) for k, t in enumerate(private_corpus(4, 40))]
    docs += [(900, f"leak of {item} here"), (901, "bench0 bench1 bench2 only"), (902, "12 34 ?!")]
    body = [f"w{k}" for k in range(80)]
    docs += [(950 + k, " ".join(body[:-1] + [f"end{k}"])) for k in range(6)] + [(990, " ".join(rnd.choice(body) for _ in range(200)))]
    d = str(tmp_path)
    frame(spark, docs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # Language: one language was given, so whatever has a letter is labelled with it.
    left = [(k, t) for k, t in docs if any(map(str.isalpha, t or ""))]
    groups = groups10(left, 5, 8, 10)
    left = [(k, t) for k, t in left if groups[k][1] == k]
    windows = {tuple(words1(item)[s : s + 10]) for s in range(5)}
    left = [(k, t) for k, t in left if not any(tuple(words1(t)[s : s + 10]) in windows for s in range(len(words1(t))))]
    texts = {k: pii.replaced(t, own) for (k, t), own in zip(left, pii_by_hand([t for _, t in left]), strict=True)}
    assert 900 not in texts and 901 in texts and 902 not in texts and sum(950 <= k < 956 for k in texts) == 1
    placed = corpus_pipeline.run(spark, d).collect()
    size, by = Counter(), defaultdict(list)
    for r in placed:
        size[r.doc_id] += r.length
        by[r.sequence_id].append((r.offset, r.length))
    from chronolake.llm.tokens import ids_of

    ids = ids_of()
    assert dict(size) == {k: len(ids.of(t)) // 4 + 1 for k, t in texts.items()}
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 2048


def test_stage_columns(spark):
    import corpus_pipeline

    docs = frame(spark, corpus(12, 12))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


@pytest.mark.parametrize("n", [100, 300, 600])
def test_candidates_of_texts_that_are_not_similar_enough(spark, monkeypatch, n):
    """Texts of one template, half of it shared, at a similarity far below the threshold: hardly any pair is verified, however many hold a token."""
    rnd = random.Random(n)
    template = [f"w{k}" for k in range(400)]

    def varied():
        words = list(template)
        for _ in range(25):
            words[rnd.randrange(400)] = f"x{rnd.randrange(10**9)}"
        return " ".join(words)

    seen, whole = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, num, den: seen.append(pairs.count()) or whole(pairs, sets, num, den))
    out = jaccard.join(frame(spark, [(k, varied()) for k in range(n)]), 3, 9, 10).collect()
    assert len(out) == n == len({r.component_id for r in out})
    assert sum(seen) <= 3 * n, seen


def test_frequent_shingles_come_after_others(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(30)]
    line = "one and the same line stands in all of these texts"
    docs = [(k, " ".join(rng.choices(words, k=30)) + f" {line} " + " ".join(rng.choices(words, k=30))) for k in range(100)]
    passage = set(jaccard.shingles(line, 3).view(np.int64).tolist())
    prefixes = jaccard._prefixes(jaccard._keyed(frame(spark, docs), "doc_id", "text"), 3, 9, 10).collect()
    assert len(prefixes) == 100 and not any(passage & set(r.tokens) for r in prefixes)


def test_no_shuffle_files_stay(spark):
    """Shuffle files of what is written are gone soon after, without a collection of garbage in the driver."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {p.name for d in dirs for p in Path(d).rglob("shuffle_*")}
    before = shuffles()
    kept = [common.written(frame(spark, corpus(3, 40)).groupBy("text").count().repartition(7, "count"), "counts"), components(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long"))]
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and len(kept) == 2, left
    assert spark.conf.get(common.CLEANUP) == "false"


@pytest.mark.parametrize("at_once", [3, 500_000])
def test_components_by_brute_force(spark, monkeypatch, at_once):
    """Tasks of few edges and of all; a chain of edges takes as many stages as a pair, when they fit one task."""
    monkeypatch.setattr(components_module, "AT_ONCE", at_once)
    rnd = random.Random(at_once)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)]
    rounds, whole = [], components_module._small_star
    monkeypatch.setattr(components_module, "_small_star", lambda e: rounds.append(1) or whole(e))
    least = {k: k for e in edges for k in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {(r.node, r.component) for r in found} == {(n, c) for n, c in least.items() if n != c} and len(found) == len(set(found))
    assert at_once == 3 or len(rounds) == 2


def test_tables_of_substring_dedup_make_room(spark, monkeypatch):
    """When segments are grouped, the texts and anchors that they came from are gone from the shared folder."""
    kept, there, whole = [], [], substring._cuts
    written = lambda df, name: kept.append((name, table := common.written(df, name))) or table
    monkeypatch.setattr(substring, "written", written)
    monkeypatch.setattr(substring, "_cuts", lambda own, *level: there.append([n for n, t in kept if Path(t.written_to.removeprefix("file://")).exists()]) or whole(own, *level))
    docs = corpus(4, 30)
    out = substring.dedup(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(out) == len(docs) and sum(r.n_removed for r in out)
    assert there[0] == ["stale", "segments"]


def test_meetings_in_turns(spark, monkeypatch):
    """Many turns list the same pairs as one."""
    docs, kinds, whole = frame(spark, corpus(6, 40)), set(), jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda *a: kinds.add(a[-1]) or whole(*a))
    monkeypatch.setattr(jaccard, "RARE_DOCUMENTS", 3)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    one = sorted(map(tuple, jaccard.join(docs, 3, 9, 10).collect()), key=str)
    monkeypatch.setattr(jaccard, "MET_EACH", 0.1)
    assert sorted(map(tuple, jaccard.join(docs, 3, 9, 10).collect()), key=str) == one
    assert max(kinds) > 1
