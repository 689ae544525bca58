"""Cross-tokenizer alignment against byte ownership, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cinderlog.llm import alignment
from cinderlog.llm.common import table

A = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def letters():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


LETTERS = letters()


def spelled(text):
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = []
    for i in b:
        piece = B.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b, a_bytes, b_bytes


def aligned(text):
    """(a ids, b ids, group text, pairs of places that overlap)"""
    if not text:
        return None
    a, b, a_bytes, b_bytes = spelled(text)
    said = (" " + text).encode()
    if b"".join(a_bytes) != said or b"".join(b_bytes) != said:
        return None
    owner_a = [k for k, x in enumerate(a_bytes) for _ in x]
    owner_b = [k for k, x in enumerate(b_bytes) for _ in x]
    links = set(zip(owner_a, owner_b))
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    return a, b, ";".join(groups), links


def brute(texts):
    found = [aligned(x) for x in texts]
    documents = Counter()
    for one in found:
        if one:
            documents.update({(one[0][i], one[1][j]) for i, j in one[3]})
    highest = defaultdict(int)
    for (a, _), n in documents.items():
        highest[a] = max(highest[a], n)
    out = []
    for one in found:
        if not one:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = one
        counts = [(documents[a[i], b[j]], highest[a[i]]) for i, j in links]
        out.append((
            len(a), len(b), groups.count(";") + 1, len(links), sum(n == m for n, m in counts),
            sum(n for n, _ in counts), hashlib.sha256(groups.encode()).hexdigest(),
        ))
    return out


def rows(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_all_documents(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    expected = [(k, *x) for (k, _), x in zip(docs, brute([t for _, t in docs]))]
    assert rows(alignment.op12_alignment(spark, sf)) == expected


TEXTS = [
    None, "", " ", "  two  spaces ", "a", "hello world", "hello world", "▁ is a piece sign", "é é ﬁ Ａ",
    "<|endoftext|> <s> </s> <unk> <0x41>", "tab\tnew\nline\r\n", "\U0001f600 emoji 你好", "\x00 nul \x7f", "word " * 30_000,
]


@pytest.mark.parametrize("broadcast_pairs", [0, 10_000_000])
def test_odd_texts_both_ways(spark, broadcast_pairs):
    data = [(k, x, 1, 2) for k, x in enumerate(TEXTS)] + [(5, "hello there", 1, 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, part int, rid int").repartition(5)
    expected = sorted((k, *x) for (k, *_), x in zip(data, brute([x[1] for x in data])))
    assert rows(alignment.aligned_counts(df, parts=4, broadcast_pairs=broadcast_pairs)) == expected
    assert any(x[1] == 0 and TEXTS[x[0]] for x in expected)  # some text isn't spelled by its tokens


def test_cuts_at_spaces_change_nothing(monkeypatch):
    """Random texts of characters that meet in odd ways, cut and whole."""
    rng = random.Random(4)
    signs = [" ", " ", "\n", "\t", "a", "b", "'s", "'", "é", "▁", ",", "1", "\u00a0", "\u3000", "\x1c", "\u0301", "the", "你"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 4, 9, 40]))) for _ in range(3000)]
    paths = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    both = alignment.Encoders(alignment.Side.byte_level(paths[0]), alignment.Side.sentence_pieces(paths[1]))
    assert both.cut is alignment.stretches
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    for text, ids in zip(texts, both.ids(texts)):
        whole = aligned(text)
        assert (ids is None) == (whole is None), text
        if ids:
            assert [np.frombuffer(x, np.int64).tolist() for x in ids] == [whole[0], whole[1]], text


@pytest.mark.parametrize("broadcast_pairs", [0, 10])
def test_empty_table_and_no_tokens(spark, broadcast_pairs):
    kinds = "doc_id long, text string"
    assert rows(alignment.aligned_counts(spark.createDataFrame([], kinds), broadcast_pairs=broadcast_pairs)) == []
    df = spark.createDataFrame([(None, None), (1, "")], kinds)
    got = alignment.aligned_counts(df, broadcast_pairs=broadcast_pairs).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_many_tasks_meet_in_a_tree(spark, monkeypatch):
    data = [(k, f"hello number {k % 7} " + "x" * (k % 5)) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(60)
    expected = sorted((k, *x) for (k, _), x in zip(data, brute([x for _, x in data])))
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "HELD", 5)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    assert rows(alignment.aligned_counts(df, parts=3)) == expected


def test_perfect_hash_is_minimal_and_verifies():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 50_000))
    at = alignment.part_of(keys, 8)
    hashes = {}
    for part in range(8):
        mine = keys[at == part]
        bits, sizes = alignment.build_hash(mine)
        one = alignment.PerfectHash(1, {0: (bits, sizes, mine)})
        numbers = one.numbers(mine)
        assert sorted(numbers.tolist()) == list(range(len(mine)))
        ordered = np.empty(len(mine), np.int64)
        ordered[numbers] = mine
        hashes[part] = (bits, sizes, ordered)
    whole = alignment.PerfectHash(8, hashes)
    assert sorted(whole.verified(keys).tolist()) == list(range(len(keys)))
    strangers = np.setdiff1d(rng.integers(0, 1 << 48, 5_000), keys)
    assert (whole.verified(strangers) == -1).all()
    assert (alignment.PerfectHash(8, {}).verified(keys) == -1).all()


def test_pairs_in_the_open(spark):
    from cinderlog.llm.common import Scratch
    from cinderlog.llm.tokens import public_tokenizer

    texts = ["hello world", "hello there", "world"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    paths = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
    found = alignment.pair_rows(alignment.pair_table(df, "text", *paths, 4, Scratch(spark, "test")))
    documents = Counter()
    for a, b, _, links in map(aligned, texts):
        documents.update({(a[i], b[j]) for i, j in links})
    assert {(r.a, r.b): r.documents for r in found.collect()} == dict(documents)
