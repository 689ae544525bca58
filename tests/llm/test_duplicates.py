import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm.common import Scratch
from cinderlog.llm.components import components
from cinderlog.llm.decontamination import contamination
from cinderlog.llm.line_dedup import dedup_lines, line_classes, not_ruled_out, within
from cinderlog.llm.minhash import near_duplicates, shingle_set, signature, _deputies


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(draw, text, times, letters="abcé"):
    out = list(text)
    for _ in range(times):
        k, how = draw.randint(0, len(out)), draw.random()
        if how < 0.4:
            out.insert(k, draw.choice(letters))
        elif how < 0.7 and k < len(out):
            out.pop(k)
        elif k < len(out):
            out[k] = draw.choice(letters)
    return "".join(out)


def test_banded_edit_distance(spark):
    draw = random.Random(3)
    rows = [("", ""), ("", "abc"), ("ab", "")]
    for _ in range(300):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(0, 9)))
        rows.append((a, edited(draw, a, draw.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string")
    for threshold in (1, 2, 3):
        for r in df.select("a", "b", within("a", "b", threshold).alias("near")).collect():
            assert r.near == (edits(r.a, r.b) <= threshold), r


def test_nothing_near_is_ruled_out(spark):
    draw = random.Random(12)
    rows = [("", ""), ("", "ab"), ("aa", "aaaa"), ("abab", "ab"), ("aab", "aba")]
    for _ in range(400):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(0, 12)))
        rows.append((a, edited(draw, a, draw.randint(0, 5), "abé")))
    df = spark.createDataFrame(rows, "a string, b string")
    for threshold in (1, 2, 3):
        found = df.select("a", "b", not_ruled_out(F.col("a"), F.col("b"), threshold).alias("may")).collect()
        assert all(r.may for r in found if edits(r.a, r.b) <= threshold)
        if threshold <= 2:  # with so few edits it rules out all others
            assert not any(r.may for r in found if edits(r.a, r.b) > threshold)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_line_links_against_brute_force(spark, threshold):
    draw = random.Random(threshold)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(8, 30))).strip("  ") for _ in range(25)]
    lines = base + [edited(draw, x, draw.randint(1, 4)).strip(" ") for x in base for _ in range(4)]
    docs = [(k, "\n".join(draw.choices(lines, k=3))) for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    first = {}
    for doc_id, text in docs:
        for place, line in enumerate(text.split("\n")):
            if len(line) >= 6:
                first.setdefault(line, (doc_id, place))
    at = dict(docs)
    rows = line_classes(df, threshold=threshold, least_chars=6).collect()
    got = {at[r.doc_id].split("\n")[r.line_no]: r for r in rows}
    assert len(got) == len(rows)
    assert got.keys() == first.keys()
    for line, r in got.items():
        near = [x for x in first if x != line and edits(x, line) <= threshold]
        earlier = min([first[x] for x in near if first[x] < first[line]], default=None)
        assert (r.doc_id, r.line_no) == first[line]
        assert r.n_links == len(near) and r.kept == (earlier is None)
        assert (r.dup_doc_id, r.dup_line_no) == (earlier or (None, None))
        assert r.n_docs == sum(line in t.split("\n") for _, t in docs)


def test_lines_are_dropped_from_texts(spark):
    long = "a line that is long enough to count here"
    rows = [
        (1, f"{long}\nshort\n{long}\nshort", "p"),
        (2, f"x\n {long}!\nanother line that nobody else has, none", "q"),
        (3, long, "r"),
        (4, None, "s"),
        (5, "", "t"),
        (None, long, "u"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _stay2 string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {
        1: f"{long}\nshort\nshort",
        2: "x\nanother line that nobody else has, none",
        3: "",
        4: None,
        5: "",
        None: long,
    }
    assert dedup_lines(df.limit(0)).collect() == []
    assert line_classes(df.limit(0)).collect() == []


def groups(docs, size, per_cent):
    """Brute force: the smallest id reachable over links."""
    sets = {}
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        if words:
            width = min(size, len(words))
            sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    up = {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(sets.get(d, ())), top(d)) for d, _ in docs}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    draw = random.Random(size)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(40):
        base = draw.choices(words, k=draw.randint(1, 160))
        docs.append(base)
        for _ in range(draw.randint(0, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append(copy)
    draw.shuffle(docs)
    rows = [(k, " ".join(x)) for k, x in enumerate(docs)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One"), (1004, "one"), (1005, "é É")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, a int")
    got = near_duplicates(df, shingle_words=size).collect()
    want = groups(rows, size, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, None, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_a_group_around_one_original(spark):
    """Edited copies that are linked with the original, and mostly not with each other."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    docs = [(900, " ".join(base))]
    for k in range(60):
        copy = list(base)
        for at in draw.sample(range(0, 300, 3), 15):
            copy[at] = f"x{draw.randrange(10**6)}"
        docs.append((k, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, shingle_words=2).collect()}
    assert got == {d: c for d, (_, c) in groups(docs, 2, 80).items()}
    assert len(set(got.values())) == 1


def test_signatures_agree_as_sets_do():
    draw = np.random.default_rng(2)
    bins = 288
    deputies = _deputies(bins)
    for size in (5, 60, 2000):
        agree = []
        for _ in range(60):
            some = lambda n: draw.integers(0, 2**64, n, dtype=np.uint64)
            both = some(size * 8 // 10)
            x, y = (np.unique(np.concatenate([both, some(size // 10)])) for _ in range(2))
            agree.append((signature(x, bins, deputies) == signature(y, bins, deputies)).mean())
        true = len(both) / (len(both) + 2 * (size // 10))
        assert abs(np.mean(agree) - true) < 0.08


def test_shingles_of_few_words():
    assert len(shingle_set("one", 2)) == 1 and len(shingle_set("a b a b", 2)) == 2
    assert len(shingle_set(None, 2)) == len(shingle_set(" \n", 2)) == 0
    assert (shingle_set("AÉ b", 2) == shingle_set("aÉ B", 2)).all()
    assert (shingle_set("É b", 2) != shingle_set("é b", 2)).all()


def test_components(spark):
    draw = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0), Scratch(spark, "t")).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    words = [[f"{letter}{i}" for i in range(40)] for letter in "ab"]
    a, b = (" ".join(w) for w in words)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, shingle_words=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_benchmark_words_whose_lower_case_depends_on_what_follows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve ΟΔΟΣ beta gamma"
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve ΟΔΟΣ.alpha"), (2, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(docs, bench).collect()}
    assert got == {1: (14, 13, ["i"]), 2: (2, 0, [])}


@pytest.mark.parametrize("hot_lines, block_lines", [(1, 1), (2, 5), (3, 1000), (10_000, 10)])
def test_lines_with_common_segments_are_counted_in_blocks(spark, hot_lines, block_lines):
    """A group of lines that differ in a number, one of edited copies, and others."""
    draw = random.Random(9)
    texts = [f"the same words in every line but for number {i:02d} of them" for i in range(40)]
    base = "another line with many copies that were edited somewhere"
    texts += [edited(draw, base, draw.randint(0, 3)) for _ in range(40)]
    texts += [edited(draw, "".join(draw.choice("abc ") for _ in range(33)), 0) for _ in range(20)]
    rows = [(i, x) for i, x in enumerate(draw.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_classes(df, threshold=2, least_chars=20, hot_lines=hot_lines, block_lines=block_lines).collect()
    firsts = {}
    for i, x in rows:
        firsts.setdefault(x.strip(), i)
    near = {i: sorted(j for y, j in firsts.items() if j != i and edits(x, y) <= 2) for x, i in firsts.items()}
    expected = {i: (len(n), n[0] if n and n[0] < i else None) for i, n in near.items()}
    assert {r.doc_id: (r.n_links, r.dup_doc_id) for r in got} == expected
