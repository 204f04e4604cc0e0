from __future__ import annotations

import random
import re

import pytest

from lumenspark.llm import suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    """Word positions of each document that lie in a window another document has."""
    where: dict[tuple, set] = {}
    words = {d: WORD.findall(t or "") for d, t in rows if d is not None}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add(d)
    out = {}
    for d, w in words.items():
        hit = set()
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                hit |= set(range(i, i + length))
        if hit:
            out[d] = hit
    return out


def fixture():
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (50, 51, 60, 75, 130, 49)]
    rows = []
    for d in range(120):
        parts = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(passages) + text(rng.randint(0, 40))
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200, None), (201, ""), (None, " ".join(passages[3])), (202, " ".join(["x"] * 300)), (203, " ".join(["x"] * 90)), (204, " ".join(["y"] * 500)), (10_000_000_000, rows[5][1])]
    return rows


@pytest.mark.parametrize("length", [50, 60])
def test_spans_equal_brute_force(spark, length):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got: dict[int, set] = {}
    for r in suffix.repeated_passages(docs, length).collect():
        span = set(range(r["first_word"], r["end_word"]))
        assert not span & got.get(r["doc_id"], set()) and r["least_doc"] <= r["doc_id"] <= r["greatest_doc"] and r["least_doc"] < r["greatest_doc"]
        got.setdefault(r["doc_id"], set()).update(span)
    assert got == brute(rows, length)


def test_cut_takes_what_a_smaller_document_has(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    out = suffix.cut_repeats(docs)
    assert out.schema == docs.schema
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    words = {d: WORD.findall(t or "") for d, t in rows}
    first: dict[tuple, int] = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, d), d)
    for d, t in rows:
        w = words[d]
        cut = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        if not cut:
            assert left[d] == t
        elif len(cut) == len(w):
            assert d not in left
        else:
            assert WORD.findall(left[d]) == [x for j, x in enumerate(w) if j not in cut]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix.repeated_passages(docs).count() == 0 and suffix.cut_repeats(docs).count() == 0


@pytest.mark.parametrize("n", [50, 60, 80, 100])
def test_excerpts_between_copies(spark, n):
    """Copies at the smallest and greatest id, excerpts of them between, one in a document that has the whole too."""
    rng = random.Random(n)
    text = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for g in range(12):
        whole, at = text(200), rng.randint(0, 200 - n)
        part = whole[at : at + n]
        rows += [(g, whole), (900 + g, whole), (100 + g, text(30) + part + text(30))]
        rows += [(200 + g, text(20) + whole + text(20) + part + text(9))] if g % 3 == 0 else []
        rows += [(300 + g, text(8) + part + text(5))] if g % 3 == 1 else []
    rows = [(d, " ".join(w)) for d, w in rows]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got: dict[int, set] = {}
    for r in suffix.repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["end_word"]))
        assert r["least_doc"] == r["doc_id"] % 100 and r["greatest_doc"] == 900 + r["doc_id"] % 100
    assert got == brute(rows, 50)


def test_string_ids_clashing_columns_and_repeats_within(spark):
    rng = random.Random(3)
    text = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    shared, own = text(70), text(55)
    rows = [("b", " ".join(text(9) + shared)), ("a-1", " ".join(shared + text(4))), ("c", " ".join(own + text(30) + own)), (None, " ".join(shared)), ("d", None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id string, text string, key int, whole int, _id int, low int")
    got = {(r["doc_id"], r["first_word"], r["end_word"], r["least_doc"], r["greatest_doc"]) for r in suffix.repeated_passages(docs).collect()}
    assert got == {("a-1", 0, 70, "a-1", "b"), ("b", 9, 79, "a-1", "b")}
    both = {(r["doc_id"], r["first_word"], r["end_word"]) for r in suffix.repeated_passages(docs, within=True).collect()}
    assert both == {("a-1", 0, 70), ("b", 9, 79), ("c", 0, 55), ("c", 85, 140)}
    left = {r["doc_id"]: r["text"] for r in suffix.cut_repeats(docs).collect()}
    assert left["a-1"] == rows[1][1] and WORD.findall(left["b"]) == WORD.findall(rows[0][1])[:9] and left["c"] == rows[2][1]
    assert left[None] == rows[3][1]


def test_common_prefixes():
    import numpy as np

    rows = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 9, 4], [1, 2, 0, 0], [1, 2, 0, 0]], np.uint32)
    assert suffix.common_prefixes(rows).tolist() == [0, 4, 2, 2, 2]
