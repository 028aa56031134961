"""Each operator against a plain brute-force version, and its defined results in edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import chat, decontaminate, imatch, jaccard, langid, pack, pii, substring, token_file, toxicity
from chronolake.llm.components import components
from chronolake.llm.suffix_array import sorted_suffixes, suffix_array, suffix_arrays
from chronolake.llm.tokens import ids_of

from .helpers import SCHEMA, corpus, rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


# 1 decontamination


def words1(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    docs = corpus(1)
    long = docs[0][1].split() or ["ka"]
    items = [(10, " ".join(docs[14][1].split()[:20])), (9, "Kan  LOST"), (8, None), (7, "..."), (6, docs[-1][1]), (5, docs[-1][1]), (4, " ".join(long[:3])), (None, "kao1")]
    windows = defaultdict(set)
    for item, text in items:
        own = words1(text)
        for s in range(max(len(own) - 9, 1)) if own else ():
            windows[tuple(own[s : s + 10])].add(str(item) if item is not None else "")
    found = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(docs)
    expected = {}
    for doc, text in docs:
        own, hit, names = words1(text), set(), set()
        for s in range(len(own)):
            for n in range(1, 11):
                if s + n <= len(own) and tuple(own[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[tuple(own[s : s + n])]
        expected[doc] = (len(own), len(hit), names - {""})
    for r in found:
        n, hit, names = expected[r.doc_id]
        assert (r.n_words, r.n_hit) == (n, hit), r
        assert [x for x in r.item_ids.split(",") if x] == sorted(names)


def test_contamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(frame(spark, corpus(2, 5)), none).collect()} == {0}
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    docs = frame(spark, corpus(2, 5))
    assert decontaminate.drop_contaminated(docs, none).columns == docs.columns


def test_rows_without_own_id_are_judged_alone(spark):
    leak, clean = "one two three four five six seven eight nine ten", "plain words about other matters"
    docs = frame(spark, [(None, leak), (None, clean), (None, None), (5, leak + " more"), (5, clean), (6, clean)])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    hits = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, bench).collect())
    assert hits == [(False, 5, 5, 0), (False, 5, 11, 10), (False, 6, 5, 0), (True, 0, 0, 0), (True, 0, 5, 0), (True, 0, 10, 10)]
    kept = [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([(None, clean), (None, None), (5, clean), (6, clean)], key=str)


# 2 chat


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_round_trip(spark, seed):
    rnd, bits, given = random.Random(seed), ["<|", "\\", "|", "<", "\n", "im_end", "|>", "a b c. ", "é😀", "<|im_end|>\n", "<|im_start|>user\n", "\\<|", ""], []
    for conv in [None, *range(12)]:
        for t in range(rnd.randint(1, 40)):
            role = rnd.choice(["user", "assistant", "system", "to\nol<|x", "\\", None]) if t else rnd.choice(["system", "user"])
            given.append((conv, rnd.choice([t, t, None, 3]), role, None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 2, 5, 60]))), "extra"))
    given.append(given[-1])
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, window string")
    out = chat.windows(df, budget=120, history=40)
    by = defaultdict(list)
    for conv, turn, role, text, _ in given:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert set(back) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(x for *_, role, x in turns if role == "assistant")
        r = back[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    fit = out.select("text", "context", F.regexp_count("text", F.lit(chat._TOKEN)).alias("n")).collect()
    assert any(r.context > 1 for r in fit)


def test_chat_of_nothing(spark):
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 3 personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+".replace("\\x20", " ")), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans3(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rnd = random.Random(0)
    for _ in range(20_000):
        text = "".join(rnd.choice(["1", "2", ".", ".", "-", " ", "+", "@", "a", "b", "(", "x", "é", "4111 1111 1111 1111", "0", "9", "\n"]) for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == spans3(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == [] and pii.base_spans("1." * 100_000)[0][0] == "ip"


def test_disclosing_terms_go(spark):
    docs = [(i, f"common talk about things by zorblax here: joe@x.org and more filler {i}") for i in range(4)] + [(i, f"common talk about things and more filler {i} here") for i in range(10, 60)] + [(90, None), (91, "")]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, docs)).collect()}
    assert all("[EMAIL]" in clean[i] and "zorblax" not in clean[i] and "common talk" in clean[i] for i in range(4))
    assert clean[10] == docs[4][1] and clean[90] is None and clean[91] == ""
    report = {r.doc_id: r for r in pii.report(frame(spark, docs)).collect()}
    assert report[0].n_email == 1 and "remove" in report[0].spans and report[10].spans == ""


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = "common talk about things and more filler in this place "
    docs = [(i, f"zorblax {far}{far}here: joe@x.org {far}{far}Zorblax") for i in range(4)] + [(i, f"{far}{i}") for i in range(10, 60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, docs)).collect()}
    assert all("zorblax" not in clean[i].lower() and clean[i].count("[EMAIL]") == 1 and clean[i].count("common talk") == 4 for i in range(4))


def test_rare_values_count(spark):
    far = "common talk about things and more filler in this place "
    docs = [(0, f"quuxly {far}once: ann@y.org {far}"), (1, f"vuvuz {far}bob@z.org"), (2, f"vuvuz {far}bob@z.org")] + [(i, far) for i in range(10, 300)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, docs)).collect()}
    assert "quuxly" not in clean[0] and "vuvuz" not in clean[1] + clean[2]
    assert all("common talk" in clean[i] for i in range(3)) and clean[10] == far


def test_personal_data_of_rows_without_own_id(spark):
    texts = [(None, "write to joe@x.org please"), (None, "a clean text that is longer than the other"), (7, "ip 10.0.0.1 here"), (7, "nothing to hide in this row")]
    clean = {r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert {texts[1][1], texts[3][1]} <= clean and len(clean) == 4 and sum("[EMAIL]" in t for t in clean) == sum("[IP]" in t for t in clean) == 1
    report = [(r.doc_id, r.n_email, r.n_ip) for r in pii.report(frame(spark, texts)).collect()]
    assert sorted(report, key=str) == sorted([(None, 1, 0), (None, 0, 0), (7, 0, 1), (7, 0, 0)], key=str)
    assert pii.sanitise(frame(spark, [])).count() == 0


# 4 substring dedup


@pytest.mark.parametrize("letters", [2, 3, 9])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        width = int(rng.integers(2, 40))
        grid = np.full((4, width), -1, np.int32)
        for row in grid:
            n = int(rng.integers(1, width + 1))
            row[: n - 1], row[n - 1] = rng.integers(1, letters, n - 1), 0
        for row, order in zip(grid, suffix_arrays(grid), strict=True):
            text = [x for x in row.tolist() if x >= 0]
            expected = sorted(range(len(text)), key=lambda i: text[i:])
            assert order[: len(text)].tolist() == expected == suffix_array(text)


def test_suffixes_of_texts_in_a_row():
    rng = np.random.default_rng(1)
    texts = [[*rng.integers(1, letters, n).tolist(), 0] for letters, n in [(2, 300), (2, 0), (256, 90), (3, 7), (5, 40), (2, 1)] * 9]
    begins = np.cumsum([0, *map(len, texts)])
    order = sorted_suffixes(np.array([x for text in texts for x in text], np.int16), np.diff(begins))
    for text, begin in zip(texts, begins, strict=False):
        assert (order[begin : begin + len(text)] - begin).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_of_all_sizes_are_sorted_together(monkeypatch):
    calls, rng = [], np.random.default_rng(2)
    monkeypatch.setattr(substring, "sorted_suffixes", lambda letters, length: calls.append(len(length)) or sorted_suffixes(letters, length))
    sorter, own = substring._Sorter(), lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    for size in range(60, 200, 20):
        one = own(size)
        sorter.add([(b"a%d" % size, one, 1), (b"b%d" % size, own(9) + one[5:], 2)])
    sorter.sort()
    assert calls == [7] and sorted(sorter.out) == sorted((b"b%d" % size, 2, 9, size - 5 + 9 - 49) for size in range(60, 200, 20))


def removed(docs):
    seen, out = {}, {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone, own = bytearray(len(data)), []
        for s in range(len(data) - 49):
            if data[s : s + 50] in seen:
                gone[s : s + 50] = b"\1" * 50
            own.append(data[s : s + 50])
        for w in own:
            seen.setdefault(w, doc)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[doc] = (len(data), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup_is_exact(spark, seed):
    docs = corpus(seed)
    base = "x" * 30 + "abcdefghij" * 12
    docs += [(1000 + k, base[k:] + str(k) + base[: 60 + k]) for k in range(12)]
    expected = removed(docs)
    for r in substring.dedup(frame(spark, docs)).collect():
        assert tuple(r)[1:5] == expected[r.doc_id], r.doc_id


def test_substring_dedup_of_nothing(spark):
    assert substring.dedup(frame(spark, [])).count() == 0


# 5 packing


def test_packing_places_every_id_once(spark):
    docs = [*corpus(5), (5, "twice"), (None, "no id")]
    ids = ids_of()
    placed = pack.pack(frame(spark, docs), capacity=64).collect()
    by, full = defaultdict(list), defaultdict(list)
    for r in placed:
        by[r.sequence_id].append(r)
        full[r.doc_id].append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = 0
    for doc, text in docs:
        data = ids.of(text) + b"\0\0\0\0"
        total += len(data) // 4
        crcs = {(k // 64, k, zlib.crc32(data[4 * k : 4 * k + 256])) for k in range(0, len(data) // 4, 64)}
        assert crcs <= {(r.piece, r.start, r.ids_crc32) for r in full[doc]}
    assert sum(r.length for r in placed) == total
    assert len(by) <= -(-total // 64) + 2
    assert pack.pack(frame(spark, [])).count() == 0


def test_plan_keeps_counts():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        back = defaultdict(int)
        for lengths, times in pack.plan(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            for n in lengths:
                back[n] += times
        assert dict(back) == counts


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    from chronolake.llm.tokens import tokenizer_path

    whole, own = Tokenizer.from_file(tokenizer_path()), ids_of()
    for _, text in [*corpus(6), (0, "It's 'Tis we'll, <|endoftext|>x ÀÉ ñ b c a!b's #1 x\x1fy ﬁ Σίσυφος İ")]:
        assert np.frombuffer(own.of(text), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


# 6 token files


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), rng.zipf(1.4, n) % 65536, np.zeros(n, np.int64)):
        assert token_file.decode(token_file.encode(ids.astype(np.int64))).tolist() == ids.tolist()


def test_damage_is_found():
    rng = np.random.default_rng(1)
    for ids in (np.arange(2100), rng.zipf(1.3, 300) % 65536, np.zeros(50, np.int64), np.array([7])):
        whole = token_file.encode(ids.astype(np.int64))
        head = token_file.HEADER.size
        damaged = [whole[:n] for n in {1, 5, head - 1, head, head + 1, len(whole) - 1, *rng.integers(1, len(whole), 10).tolist()} - {head + token_file.HEADER.unpack_from(whole)[2]}]
        for bit in {*range(0, 8 * head, 5), *rng.integers(8 * head, 8 * len(whole), 15).tolist()}:
            data = bytearray(whole)
            data[bit // 8] ^= 1 << bit % 8
            damaged.append(bytes(data))
        damaged += [whole[:head] + rng.integers(0, 256, len(whole) - head).astype(np.uint8).tobytes() for _ in range(5)]
        refused = 0
        for data in damaged:
            try:
                assert token_file.decode(data).tolist() == ids.tolist()  # bits that no id needs
            except ValueError:
                refused += 1
        assert refused >= 0.8 * len(damaged)


def test_token_file(spark, tmp_path):
    docs = [*corpus(7), (5, "again")]
    token_file.write(frame(spark, docs), str(tmp_path / "f"))
    ids, at = ids_of(), 0
    back = sorted(token_file.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert len(back) == len(docs)
    for (doc, text), r in zip(sorted(docs, key=lambda d: (d[0], d[1] or "")), back, strict=True):
        data = ids.of(text) + b"\1\0\0\0"
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(data) // 4, zlib.crc32(data))
        at += len(data) // 4
    token_file.write(frame(spark, []), str(tmp_path / "g"))
    assert token_file.read(spark, str(tmp_path / "g")).count() == 0


# 7 fingerprints


def test_fingerprints(spark):
    docs = [*corpus(8, 120), (None, "no id ka lo")]
    found = imatch.fingerprints(frame(spark, docs)).collect()
    order = sorted(((d if d is not None else -(1 << 63)), t or "") for d, t in docs)
    expected = {}
    for k, (doc, text) in enumerate(order):
        cut, nxt = len(text) // 2, order[(k + 1) % len(order)][1]
        expected[doc] = (len(text), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest())
    by_text = defaultdict(set)
    texts = dict(docs)
    for r in found:
        assert (r.n_chars, r.edited_sha256) == expected[r.doc_id if r.doc_id is not None else -(1 << 63)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[texts[r.doc_id] or ""].add(r.fingerprint)
    assert len(found) == len(docs) and all(len(v) == 1 for v in by_text.values())
    assert imatch.fingerprints(frame(spark, [])).count() == 0
    one = imatch.fingerprints(frame(spark, [(3, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# 8 language


def test_viterbi_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
        labels, at = langid.viterbi(scores, sizes, 0.7), 0
        for n in sizes:
            value = lambda p: sum(scores[at + i, p[i]] for i in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            if n:
                assert abs(max(map(value, itertools.product(range(3), repeat=int(n)))) - value(labels[at : at + n])) < 1e-4
            at += n


def test_languages(spark):
    rnd = random.Random(2)
    say = {"aa": ["kam", "lok", "mak", "tik"], "bb": ["ñuel", "séra", "ñola"], "ru": ["привет", "мир", "слово"]}
    talk = lambda lang, n: " ".join(rnd.choice(say[lang]) for _ in range(n))
    known = [(i, talk(lang, 30), lang) for lang in say for i in range(20)] + [(99, None, "aa"), (98, "x", None)]
    model = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    asked = [(1, talk("aa", 9)), (2, talk("ru", 9)), (3, None), (4, "123 ?!"), (5, talk("aa", 30) + " " + talk("bb", 20)), (6, ""), (7, talk("bb", 20_000))]
    out = {r.doc_id: r for r in langid.identify(frame(spark, asked), model).collect()}
    assert [out[k].lang_pred for k in range(1, 8)] == ["aa", "ru", "und", "und", "aa", "und", "bb"]
    assert [x.split(":")[2] for x in out[5].spans.split(",")] == ["aa", "bb"] and out[3].score == 0
    assert {r.doc_id for r in langid.keep_identified(frame(spark, asked), model).collect()} == {1, 2, 5, 7}
    assert langid.identify(frame(spark, asked), {}).where("lang_pred = 'und'").count() == 7


def test_held_out_languages(spark):
    from chronolake.llm.queries import op8_language_id

    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = op8_language_id(spark, d).where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


# 9 toxicity


def test_restores_disguised_words(spark):
    said = " ".join(["you stupid moron that is pathetic trash"] * 3)
    letters = toxicity.letter_model(frame(spark, [(1, said), (2, None)])).tolist()
    assert [toxicity.restore(w, letters) for w in ("m0r0n", "s.t.u.p.i.d", "p@thet1c", "tr4$h", "moroooooon")] == ["moron", "stupid", "pathetic", "trash", "moron"]


def test_toxicity_learns_and_takes_edges(spark):
    docs = [(i, f"plain words here {i} and " + ("stupid moron" if i % 4 == 0 else "nothing else")) for i in range(200)] + [(900, "m 0 r 0 n"), (901, None), (902, ""), (903, "St.upid!!")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    df = frame(spark, docs)
    out = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    assert min(out[i] for i in range(0, 200, 4)) > 0.5 > max(out[i] for i in range(200) if i % 4)
    assert out[900] > 0.3 and out[903] > 0.3 and 0 <= out[901] == out[902] < 0.5
    none = toxicity.train(df, labels.where("false"))
    assert {round(r.score, 6) for r in toxicity.score(df, none).collect()} == {0.0}


# 10 Jaccard join


def shingles10(text, size):
    own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(own[i : i + size]) for i in range(max(len(own) - size + 1, 1))} if own else set()


def groups10(docs, size, num, den):
    sets, root = {d: shingles10(t, size) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(9, 3, 9, 10), (10, 5, 8, 10), (11, 2, 8, 10)])
def test_join_is_exact(spark, seed, size, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE_DOCUMENTS", 3)  # so that pairs of tokens are indexed as well
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    docs = corpus(seed)
    for k in range(40):
        own = list(base)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(60)] = f"z{rnd.randrange(400)}"
        docs.append((2000 + k, " ".join(own[rnd.randrange(3) :])))
    expected = groups10(docs, size, num, den)
    out = jaccard.join(frame(spark, docs), size, num, den).collect()
    assert len(out) == len(docs) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, docs), size=size, num=num, den=den).collect()}
    assert kept == {d for d, (_, c) in expected.items() if c == d}


def test_join_of_nothing(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    assert jaccard.join(frame(spark, [(None, "a b"), (3, "A b"), (4, None)]), 3).orderBy("doc_id").collect()[1:] == [(3, 1, None), (4, 0, 4)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 9), (7, 7), (5, 1)]
    assert {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(2, 1), (3, 1), (4, 1), (5, 1), (9, 8), (20, 8)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = frame(spark, [*corpus(12), *((3000 + k, f"plain words number {k} " + "mi kast " * 5) for k in range(3))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before, name
    assert docs.count() > 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert placed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
