from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenspark.llm import shared, tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World! it's  FINE\n\nok", "a<|endoftext|>b", "étude ÉTUDE é", "x" * 3000, "the cat sat on the mat. " * 400, "\x1c\x85   ß ﬁ", "1234567890 3.14", "<|startoftext|>", "the cat sat on the mat. " * 400]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
@pytest.mark.parametrize("base", [50, 60_000, 70_000])
def test_grammar_round_trip(n, base):
    rng = np.random.default_rng(n + base)
    ids = np.minimum(rng.zipf(1.3, n), base - 1).astype(np.uint32)
    ids[n // 2 : n // 2 + n // 4] = 7
    symbols, rules, lengths, bounds = tokenfiles.compress(ids, base, pairs=300, exhaust=True)
    assert (tokenfiles.expand(symbols, rules, bounds) == ids).all() and (tokenfiles.expand_only(symbols, rules, base) == ids).all()
    short, its_rules, _, its_bounds = tokenfiles.compress(ids, base, pairs=300)
    assert (tokenfiles.expand(short, its_rules, its_bounds) == ids).all() and 2 * len(short) + 12 * len(its_rules) <= 2 * len(ids)
    assert n < 1000 or len(symbols) < n
    row = {"symbols": symbols.astype("<u4").tobytes(), "wide": True, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "rounds": bounds}
    for a, b in [(0, n), (n // 3, n // 2), (5, 6), (n, n + 5), (-3, 2)]:
        assert (tokenfiles.decode_range(row, a, b) == ids[max(a, 0) : b]).all()


def test_files_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (-5, "first")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    got = sorted((tuple(r) for r in tokenfiles.write_and_read(docs, PATH).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(PATH)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_small_shards_and_random_access(spark):
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(40)], "doc_id long, text string")
    folder = shared.new_folder(spark, "t")
    tokenfiles.write_files(docs, folder, PATH, shard_tokens=500)
    library = Tokenizer.from_file(PATH)
    for row in spark.read.parquet(folder).collect():
        for k, doc in enumerate(row["doc_ids"]):
            ids = tokenfiles.decode_range(row.asDict(), row["doc_starts"][k], row["doc_starts"][k + 1])
            assert ids.tolist() == [*library.encode(TEXTS[doc % len(TEXTS)] or "", add_special_tokens=False).ids, 2]
    assert tokenfiles.read_files(spark, folder).count() == 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.write_and_read(docs, PATH).count() == 0


@pytest.mark.parametrize("base", [50, 60_000, 70_000])
def test_every_rule_pays(base):
    """Rules of the last round, which are used by symbols only, save more than they take."""
    rng = np.random.default_rng(base)
    ids = np.minimum(rng.zipf(1.3, 20_000), base - 1).astype(np.uint32)
    symbols, rules, _, bounds = tokenfiles.compress(ids, base, pairs=300)
    assert (tokenfiles.expand(symbols, rules, bounds) == ids).all() and 2 * len(symbols) + tokenfiles.RULE_BYTES * len(rules) < 2 * len(ids)
    assert 2 * np.bincount(symbols)[bounds[-2] :].min() > tokenfiles.RULE_BYTES
