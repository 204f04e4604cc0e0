"""Operators against the library or brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenspark.llm import bpe, chaining, fst, jaccard, mixing, packed, quality, shared, textops, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    signs = list("ab str'vedlmtn  \n\t\r 123!?.,'\"é中  😀ñ²Ⅷ'''<|>‍́\x1c\x85AZ")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_tokens_equal_regex():
    texts = [*odd_texts(500, 1), None, "", " ", "x" * 5000]
    t = textops.tokenize_column(pa.array(texts))
    known: dict[bytes, int] = {}
    at = 0
    for i, text in enumerate(texts):
        words = [w.encode() for w in WORD.findall(text or "")]
        assert t.row_start[i + 1] - t.row_start[i] == len(words)
        for w in words:
            raw = (text or "").encode()
            assert raw[t.start[at] : t.start[at] + t.length[at]] == w
            assert known.setdefault(w, int(t.hashes[at])) == int(t.hashes[at])
            at += 1
    assert len(set(known.values())) == len(known)


def test_blocks_do_not_part_words(monkeypatch):
    texts = pa.array(odd_texts(60, 2) + ["y" * 900, " ".join(["ab"] * 700)])
    whole = textops.tokenize_column(texts)
    monkeypatch.setattr(textops, "BLOCK", 64)
    small = textops.tokenize_column(texts)
    assert all((a == b).all() for a, b in zip(whole[:4], small[:4], strict=True))


def test_bpe_and_counts_equal_the_library():
    texts = [*odd_texts(4000, 3), "", "a<|endoftext|>b's<|endoftext|>", "aaaa" * 300, " " * 700, "'re 've' 'r", "x" * 20_000, "é" * 3000]
    library, vocabulary = Tokenizer.from_file(BYTES), bpe.load_vocabulary(BYTES)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = bpe.Encoder(vocabulary).encode(pa.array(texts))
    assert [x.tolist() for x in got] == want
    assert fst.Counter(vocabulary).count(pa.array(texts)).tolist() == [len(x) for x in want]
    assert [vocabulary.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want] == texts
    broken = [[50256, 0, 255, 128], [200, 201], [130]]
    assert [vocabulary.decode(np.array(x)) for x in broken] == [library.decode(x, skip_special_tokens=False) for x in broken]


def test_long_words_equal_the_library():
    vocabulary, library = bpe.load_vocabulary(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(5)
    words = ["".join(rng.choice(x) for _ in range(n)) for n in (1, 50, 3000, 6000) for x in ("a", "ab", "etaoinshrdlu", "éà中x")]
    for w, packed in zip(words, vocabulary.encode_words(words), strict=True):
        assert np.frombuffer(packed, vocabulary.kind).tolist() == library.encode(w, add_special_tokens=False).ids
        first = vocabulary.of_byte[np.frombuffer(w.encode(), np.uint8)]
        assert bpe.merge_long(first, vocabulary.keys, vocabulary.rank_of_key, vocabulary.product, vocabulary.size).tolist() == library.encode(w, add_special_tokens=False).ids
    assert len(vocabulary.encode_words(["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))])[0]) > 100_000


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="only byte-level BPE"):
        bpe.Vocabulary(str(tmp_path / "x.json"))


def test_added_columns_do_not_clash(spark):
    docs = spark.createDataFrame([("a", "some text", 1, 2)], "doc_id string, text string, ids int, decoded int")
    coded = bpe.encode_documents(docs, BYTES)
    assert coded.columns == ["doc_id", "text", "ids", "decoded", "ids_"]
    assert bpe.decode_ids(coded, BYTES, "ids_").first()["decoded_"] == "some text"


def test_counts_query_equals_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(i, t) for i, t in enumerate(odd_texts(60, 8))] + [(1000, None), (1001, ""), (1002, "word " * 600)]
    got = {r["doc_id"]: tuple(r)[1:] for r in fst.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_near_duplicates_of_one_id_on_several_texts(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(3, text("w"), 1), (7, text("w"), 2), (7, text("v"), 3), (9, text("v"), 4), (3, text("w"), 0), (None, text("w"), 5), (11, "", 6), (11, "", 6), (12, None, 7)]
    want = sorted([(3, text("w"), 0), (7, text("v"), 3), (11, "", 6), (12, None, 7), (None, text("w"), 5)], key=str)
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n int")
        assert sorted((tuple(r) for r in jaccard.drop_near_duplicates(docs).collect()), key=str) == want


def test_memo_forgets_but_stays_right():
    memo = bpe.Memo(lambda words: [len(w) for w in words], limit=5)
    rng = random.Random(4)
    for _ in range(50):
        words = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 12))]
        assert memo.look_up(words) == [len(w) for w in words]


def test_round_trip_digests(spark):
    texts = [*odd_texts(50, 5), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    for r in bpe.round_trip_digests(docs, BYTES).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(("k", "num", "near"), [(4, 85, 3), (5, 80, 6), (3, 60, 30)])
def test_jaccard_components_equal_brute_force(spark, k, num, near):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.randint(0, near)):
                if text:
                    text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n"]).join(text).upper() if g % 3 else " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, rows[20][1])]
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        sets[d] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, k, num, 100).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}
    kept = {r["doc_id"] for r in jaccard.drop_near_duplicates(docs, k, num, 100).select("doc_id").collect()}
    assert kept == {d for d in ids if find(d) == d}


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(6)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
            drop = int(len(a) * rng.random() * (den - num) / den)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 52, int(rng.integers(0, drop + 1))).astype(np.uint64))))
            shared_n = len(np.intersect1d(a, b))
            if den * shared_n < num * (len(a) + len(b) - shared_n) or len(np.setxor1d(a, b)) == 0:
                continue
            keys, row = jaccard.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), num, den)
            assert np.intersect1d(keys[row == 0], keys[row == 1]).size
            offsets = np.array([0, len(a), len(a) + len(b)])
            bits = jaccard.sketches_of(np.concatenate((a, b)), offsets, [0, 1])
            fits = jaccard.Sketches(np.diff(offsets), bits, num, den).fit(0, np.array([1]))
            assert fits.tolist() == [1] and len(jaccard._fitting_twos(np.array([0]), np.array([5, 6]), np.diff(offsets), np.array(bits, object), num, den)) == 1


def test_shared_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i % 37, rng.randint(0, 60)) for i in range(600)]
    docs = spark.createDataFrame([(o, str(k)) for o, k in rows], "owner long, text string").repartition(5)
    keys = lambda b: (np.array([int(x) for x in b.column(1).to_pylist()], np.uint64), b.column(0).to_numpy())
    owners: dict[int, set] = {}
    for o, k in [*rows, (1, 1000), (1, 1000)]:
        owners.setdefault(k, set()).add(o)
    docs = docs.union(spark.createDataFrame([(1, "1000"), (1, "1000")], "owner long, text string"))
    want = {(k, o) for k, s in owners.items() if len(s) > 1 for o in s}
    for parts, buckets in ((7, 0), (1, 1), (3, 40)):
        assert {tuple(r) for r in packed.shared_pairs(docs, keys, parts, buckets).collect()} == want


def test_bit_table_lets_all_members_through(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5000)
    df = spark.createDataFrame([(int(x),) for x in values], "v long")
    table = packed.BitTable(df, "v")
    assert table.may_hold(values).all()
    assert table.may_hold(np.arange(5000)).mean() < 0.01


def test_distributed_components_of_many_edges(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 3000)] + [(10_000, 10_000 + i) for i in range(1, 20_000)] + [(40_000 + rng.randrange(30_000), 40_000 + rng.randrange(30_000)) for _ in range(40_000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert dict(shared.components(df, 0).collect()) == dict(shared.components(df).collect())


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 9), (9, 8), (3, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(shared.components(df).collect())
    assert got == dict(shared.components(df, 10).collect()) == {i: 1000 for i in range(1000, 1201)} | {i: 5000 for i in range(5000, 5300)} | {7: 7, 8: 7, 9: 7}
    assert shared.components(df.where("a = 3")).count() == 0


def test_ranks_and_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 500), i, rng.randint(0, 9)) for i in range(800)]
    from pyspark.sql import functions as F

    got = {(r["k"], r["i"]): r["before"] for r in shared.numbered(spark.createDataFrame(rows, "k long, i long, w long"), [F.col("k"), F.col("i")], "before", "w").collect()}
    total, want = 0, {}
    for k, i, w in sorted(rows):
        want[k, i] = total
        total += w
    assert got == want


def test_mix_hits_its_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(tuple, report)) == sorted(map(tuple, again))
    of = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in report:
        assert r["taken"] <= 3 * r["size"]
        t = taken.setdefault(of[r["doc_id"]], [r["target"], 0, r["source_size"]])
        t[1] += r["taken"]
    assert abs(sum(t[0] for t in taken.values()) - sum(t[2] for t in taken.values())) < 1e-6
    for target, words, size in taken.values():
        assert abs(words - target) <= 3 * 200 and target <= 3 * size
    copies = {r["doc_id"]: r["copies"] for r in report}
    counts: dict = {}
    for r in mixing.mix(docs).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {d: n for d, n in copies.items() if n}


def test_segments_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        s = np.round(rng.normal(-0.2, 1, int(rng.integers(0, 14))), 2)
        found = toxicity.segments(s)
        best = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert (max((x for x, _, _ in found), default=0) == pytest.approx(max(best, 0))) and all(x > 0 for x, _, _ in found)
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))
        assert all(x == pytest.approx(s[a:b].sum()) for x, a, b in found)
        # Every positive word lies in one segment, and no segment can be parted or joined for a higher score.
        assert {i for i in np.flatnonzero(s > 0)} <= {i for _, a, b in found for i in range(a, b)}
        for _, a, b in found:
            assert all(s[a:i].sum() > -1e-9 and s[i:b].sum() > -1e-9 for i in range(a + 1, b))


def test_toxicity_is_accurate_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    rows = [(r["doc_id"], r["score"], r["toxic"], r["predicted"]) for r in scored.join(labels, "doc_id").collect()]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, _, p in rows)
    held = [(s, t) for d, s, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.75


def test_quality_equals_brute_force():
    rng = random.Random(5)
    words = ["of", "the", "a#", "cat.", "|", "é", "メニュー", "fin…", "終。", "😀", "x" * 9, "All", "rights", "reserved", "Tous", "droits réservés"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", " "]) for _ in range(rng.randint(1, 25))) for _ in range(300)] + ["", None, "a b c " * 50]
    got = quality.judge(pa.array(texts))
    for i, text in enumerate(texts):
        text = text or ""
        w = WORD.findall(text)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines, seen, dup, lost = text.split("\n"), set(), 0, 0
        for line in lines:
            lw = WORD.findall(line)
            if not lw:
                continue
            dup += line in seen
            seen.add(line)
            end = lw[-1][-1]
            bad = sum(c in "#*$%&|<>" for c in line) * 10 > len(lw) or (len(lw) < 4 and end not in ".!?:;,\"')]}…”’“»›‹«。！？：；，、）」』】》؟۔।") or "all rights reserved" in line.lower() or "tous droits réservés" in line.lower()
            lost += len(lw) * bad
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": failed, "lost_words": lost, "kept": not failed and 2 * lost <= len(w)}
        assert {k: got[k][i] for k in want} == want


def test_cleaning_removes_bad_lines(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, f"{good}\nHome | News | About\n{good.replace('word', 'other')}", "x"), (2, "short", "y"), (3, None, "z")], "doc_id long, text string, note string")
    assert [tuple(r) for r in quality.clean(docs).collect()] == [(1, f"{good}\n{good.replace('word', 'other')}", "x")]


def test_chains_equal_brute_force():
    rng = random.Random(3)

    def value(xs, ys):
        return 6 * len(xs) - 0.25 * sum(b - a - 6 + d - c - 6 for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False))

    for _ in range(200):
        points = sorted({(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(rng.randint(1, 30))})
        best = []
        for i, (x, y) in enumerate(points):
            best.append(6 + max([0.0, *(best[j] - 0.25 * (x - a + y - b - 12) for j, (a, b) in enumerate(points[:i]) if a < x and b < y)]))
        found = chaining.chains([p[0] for p in points], [p[1] for p in points])
        assert value(*found[0]) == pytest.approx(max(best)) and sum(len(a) for a, _ in found) == len(points)


def test_fuzzy_passages_find_planted_ones(spark):
    rng = random.Random(11)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, planted = [], set()
    passage, copied = text(90), text(70)
    for d in range(60):
        body = text(120)
        if d % 6 == 0:
            body[40:40] = copied
            planted.add(d)
        if d % 6 == 1:
            fuzzy = list(passage)
            for _ in range(4):
                fuzzy[rng.randrange(90)] = "changed" + str(rng.random())
            body[30:30] = fuzzy
            planted.add(d)
        rows.append((d, " ".join(body)))
    rows += [(100, None), (None, " ".join(passage)), (101, " ".join(passage[:30]))]
    found = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} | {r["other_doc"] for r in found} == planted
    for r in found:
        size = (70 if r["doc_id"] % 6 == 0 else 90) + 2
        assert r["doc_id"] % 6 == r["other_doc"] % 6 and 50 <= r["end_word"] - r["first_word"] <= size and r["matching_words"] >= 0.8 * (r["end_word"] - r["first_word"])


def test_passages_of_frequent_lines_between_others(spark):
    """Each line of a passage of two documents in the middle is also in one smaller and one greater document."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for g, (n, size) in enumerate([(2, 45), (3, 40), (4, 30), (2, 45), (3, 40), (4, 30)]):
        lines = [text(size) for _ in range(n)]
        for d in (1000 + 10 * g, 1005 + 10 * g):
            rows.append((d, " ".join(text(20) + sum(lines, []) + text(20))))
        want.add((1005 + 10 * g, 1000 + 10 * g, n * size))
        for i, line in enumerate(lines):
            rows += [(10 * g + i, " ".join(text(30) + line + text(30))), (5000 + 10 * g + i, " ".join(text(30) + line + text(30)))]
    found = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc"], r["matching_words"]) for r in found} == want


def test_passages_between_others_that_share_a_link_each(spark):
    """Two documents in the middle share a passage; of its lines every two that follow each other are also in other documents, smaller and
    greater, which share nothing of 50 words with them or with each other."""
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(4):
        lines = [text(20) for _ in range(4)]
        for d in (10_000 + 10 * g, 10_005 + 10 * g):
            rows.append((d, " ".join(text(20) + sum(lines, []) + text(20))))
        want.add((10_005 + 10 * g, 10_000 + 10 * g, 80))
        for i in range(3):
            for d in (*range(3), *range(50_000, 50_003)):
                rows.append((d + 1000 * g + 100 * i, " ".join(text(30) + lines[i] + lines[i + 1] + text(30))))
    found = chaining.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc"], r["matching_words"]) for r in found} == want


def test_passages_of_seeds_of_many_documents(spark, monkeypatch):
    """The same where seeds and pairs of seeds are in more documents than are compared by them alone."""
    monkeypatch.setattr(chaining, "LARGE", 3)
    test_passages_between_others_that_share_a_link_each(spark)
    test_passages_of_frequent_lines_between_others(spark)
    test_fuzzy_passages_find_planted_ones(spark)


def test_encoder_holds_few_words():
    """Workers keep an encoder for good, beside all that later tasks take."""
    encoder, library = bpe.Encoder(bpe.load_vocabulary(BYTES)), Tokenizer.from_file(BYTES)
    for part in range(4):
        text = " ".join(f"w{i}x{part}" for i in range(50_000))
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.memo.known) <= 150_000
