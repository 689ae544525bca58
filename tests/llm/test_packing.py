import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cinderlog.llm.packing import WINDOW, fillings, make_plan, pack, solve
from cinderlog.llm.token_counts import (
    LIMITS, QUANTILES, length_histogram, op2_token_counts, quantiles, suffix_sums, truncated_totals, with_limits, with_quantiles,
)
from cinderlog.llm.tokens import Encoder, public_tokenizer

SCHEMA = "doc_id long, text string, length string, sequence_id long, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizer())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encoder, draw = Encoder(public_tokenizer()), random.Random(1)
    letters = "ab'sStlvrem d  \n\t\x85\xa0\x1c_²¼ªé’1٣½-.  Ж漢😀ß́"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        assert encoder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, docs, tokenizer, window=WINDOW):
    """Every id in exactly one piece, every sequence gapless and without padding."""
    want = Counter()
    for doc_id, text in docs:
        whole = ids_of(tokenizer, text)
        want.update((doc_id, i, int(t), len(whole)) for i, t in enumerate(whole))
    texts = defaultdict(list)
    for doc_id, text in docs:
        texts[doc_id].append(ids_of(tokenizer, text))
    got, sequences = Counter(), defaultdict(list)
    for r in rows:
        part = next(
            t[r.start : r.start + r.length]
            for t in texts[r.doc_id]
            if len(t) == r.doc_tokens and zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        )
        if r.ids is not None:
            assert bytes(r.ids) == part.tobytes()
        got.update((r.doc_id, r.start + i, int(t), r.doc_tokens) for i, t in enumerate(part))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_documents_come_back_whole(spark, sf, tokenizer):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer)


def test_nulls_empty_long_repeated_and_clashing_columns(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b c"), (4, "a b c"), (None, "no id")]
    docs += [(k, "same text here") for k in range(10, 400)]
    df = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in docs], SCHEMA)
    check(pack(df).collect(), docs, tokenizer)
    check(pack(df, window=16).collect(), docs, tokenizer, 16)
    assert pack(df.limit(0)).collect() == []


def test_fillings_are_all_multisets():
    rows = {tuple(sorted(x for x in r if x)) for r in fillings(np.arange(1, 17), 16, 3)}
    want = {(16,)} | {(a, 16 - a) for a in range(1, 9)}
    want |= {(a, b, 16 - a - b) for a in range(1, 17) for b in range(a, 17) if 16 - a - b >= b}
    assert rows == want


def test_least_squares_meet_a_histogram_that_can_be_met():
    columns = fillings(np.arange(1, 65), 64, 3)
    draw = np.random.default_rng(3)
    times = np.where(draw.random(len(columns)) < 0.05, draw.integers(1, 50, len(columns)), 0)
    counts = np.zeros(65)
    for row, n in zip(columns, times):
        for length in row[row > 0]:
            counts[length] += n
    x = solve(columns, counts)
    met = np.zeros(65)
    for row, n in zip(columns, x):
        for length in row[row > 0]:
            met[length] += n
    assert (x >= 0).all() and np.abs(met - counts).max() < 0.02 * counts.max()


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_rank_once(seed):
    draw = np.random.default_rng(seed)
    counts = np.concatenate([[0], draw.integers(0, 40, 64) * (draw.random(64) < 0.7)])
    plan = make_plan(counts, 64)
    used = defaultdict(set)
    for n in range(1, 65):
        for rank in range(counts[n]):
            k = np.searchsorted(plan.key, n << 40 | rank, "right") - 1
            step = rank - (plan.key[k] & ((1 << 40) - 1))
            at = plan.seq[k] + step if plan.seq[k] >= 0 else plan.stream
            place = plan.at[k] if plan.seq[k] >= 0 else plan.at[k] + step * n
            if plan.seq[k] >= 0:
                cells = {(at, place + i) for i in range(n)}
            else:
                cells = {(at + (place + i) // 64, (place + i) % 64) for i in range(n)}
            assert not cells & used["all"]
            used["all"] |= cells
    assert len(used["all"]) == (np.arange(65) * counts).sum()


def test_histogram_and_suffix_sums(spark, sf, tokenizer):
    df = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"), allowMissingColumns=True
    )
    lengths = [len(ids_of(tokenizer, r.text)) - 1 for r in df.collect()]
    sums = suffix_sums(length_histogram(df), block=64)
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_ge == sum(x >= n for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= n)
        assert r.docs_below == sum(x < n for x in lengths)
        assert r.tokens_below == sum(x for x in lengths if x < n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
    limits = [0, 1, 100, 1000, 10**6]
    got = {r.limit: r.tokens for r in truncated_totals(sums, limits).collect()}
    assert got == {m: sum(min(x, m) for x in lengths) for m in limits}
    got = {r.q: r.n_tokens for r in quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert got == {q: ordered[-(-int(q * 1000) * len(ordered) // 1000) - 1] for q in (0.1, 0.5, 1.0)}
    assert suffix_sums(length_histogram(df.limit(0))).collect() == []


def test_the_query_answers_limits_and_quantiles(spark, sf, tokenizer):
    lengths = [len(ids_of(tokenizer, r.text)) - 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = {r.n_tokens: r for r in op2_token_counts(spark, sf).collect()}
    assert set(rows) == set(lengths) | set(LIMITS)
    asked = {}
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.is_limit == (n in LIMITS)
        assert (r.docs_ge, r.docs_below) == (sum(x >= n for x in lengths), sum(x < n for x in lengths))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        asked |= {float(q): n for q in r.quantiles.split(",") if q}
    want = {q: min(n for n in lengths if sum(x <= n for x in lengths) / len(lengths) >= q) for q in QUANTILES}
    assert asked == want


def test_limits_and_quantiles_of_nothing_and_of_ties(spark):
    schema = "n_tokens long, n_docs long"
    none = with_quantiles(suffix_sums(with_limits(spark.createDataFrame([], schema), [4, 4, 8])), [0.5]).collect()
    assert sorted((r.n_tokens, r.n_docs, r.truncated_tokens, r.quantiles) for r in none) == [(4, 0, 0, ""), (8, 0, 0, "")]
    ties = spark.createDataFrame([(5, 4), (9, 4)], schema)
    got = with_quantiles(suffix_sums(with_limits(ties, [7])), [0.5, 0.51, 1.0]).collect()
    assert {r.n_tokens: r.quantiles for r in got} == {5: "0.5", 7: "", 9: "0.51,1.0"}


def test_ids_are_placed_without_python(spark):
    """Python gets a piece's length and rank only: batches of ids took an executor's memory."""
    docs = spark.createDataFrame([(1, "some words " * 900), (2, None), (3, "cut here")], "doc_id long, text string")
    plan = pack(docs, all_ids=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    (python,) = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    called = python[python.index("parts(") :].split(")")[0]
    assert "length" in called and "rank" in called and "ids" not in called
