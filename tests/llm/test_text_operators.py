import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import language, secrets
from cinderlog.llm.decontamination import contamination, is_contaminated
from cinderlog.llm.html_text import extract, main_text
from cinderlog.llm.quality import learn, score


def words_of(text):
    lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits(text, items, span):
    words, covered, found = words_of(text), set(), set()
    for item_id, item in items:
        other = words_of(item)
        n = min(span, len(other))
        windows = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                covered.update(range(i, i + n))
                if item_id is not None:
                    found.add(str(item_id))
    return len(words), len(covered), sorted(found)


@pytest.mark.parametrize("span,k", [(13, 5), (6, 2)])
def test_contamination_against_brute_force(spark, span, k):
    draw = random.Random(span)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "İ", "K", "9"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(15)]
    items += [(99, None), (98, ""), (97, "..."), (None, "only here to see"), (3, items[4][1])]
    docs = []
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(0, 80))
        for _ in range(draw.randint(0, 2)):
            other = words_of(draw.choice(items)[1] or "")
            at, start = draw.randint(0, len(words)), draw.randint(0, max(0, len(other) - 5))
            words[at:at] = other[start : start + draw.randint(1, 30)]
        docs.append((i, draw.choice([" ", ", ", "-"]).join(x.upper() if draw.random() < 0.2 else x for x in words)))
    docs += [(100, None), (101, ""), (None, docs[5][1]), (5, docs[5][1]), (102, "Only here, to SEE!")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, marks string")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = contamination(df, bench, span=span, k=k).withColumn("bad", is_contaminated()).collect()
    want = sorted(((d, *hits(t, items, span)) for d, t in docs), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == want
    assert all(r.bad == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    assert all(r.n_items == len(r.item_ids) for r in got)
    assert sum(r.n_hit for r in contamination(df, bench.limit(0)).collect()) == 0
    assert contamination(df.limit(0), bench).collect() == []


def secret(draw, letters, n):
    return "".join(draw.choice(letters) for _ in range(n))


def test_base_spans():
    key = "AKIA" + "A1" * 8
    text = f'é password = "abc123" token: token: hunter22 {key} AKIA123 {"0f" * 12} {"0f" * 11} API-KEY=x api_key="zzzzzz'
    got = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.base_spans(text)]
    assert got == [
        ("assign", 'password = "abc123'),
        ("access", key),
        ("hex", "0f" * 12),
        ("assign", 'api_key="zzzzzz'),
    ]
    # the first match takes the second key word as its value, which is too short
    assert secrets.base_spans("token: token: hunter22") == []
    assert secrets.base_spans("tokeKKen=abcdefg paſſword=abcdefg") == []


def test_random_strings_stand_out(spark):
    draw = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda n: "".join(draw.choices(syllables, k=n))
    planted, rows = {}, []
    for k in range(300):
        text = " ".join(word(draw.randint(1, 4)) for _ in range(60)) + " "
        if k % 10 == 0:
            text += word(12) + " " + "a" * 40 + " " + "abcdefghij" * 4 + " " + "1234567890" * 4 + " "
        if k % 15 == 0:
            n = draw.choice([40, 64])
            planted[k] = (len(text), len(text) + n)
            text += secret(draw, string.ascii_letters + string.digits + "+/", n)
        rows.append((k, text))
    rows += [(1000, None), (1001, ""), (None, "none")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert len(got) == len(rows) and got[1000] == got[1001] == got[None] == []
    found = [(d, x.start, x.end) for d, s in got.items() for x in s if x.kind == "random"]
    assert sorted(found) == sorted((d, *x) for d, x in planted.items())
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_tests_of_the_battery():
    draw = random.Random(1)
    even = [secrets.battery(secret(draw, "0123456789abcdef", 64), 1) for _ in range(400)]
    chi = [x[0] for x in even]
    assert abs(np.mean(chi) - 15) < 1
    assert 0.9 < np.mean([x[1] > 0.05 for x in even]) <= 1 and 0.9 < np.mean([x[2] > 0.05 for x in even]) <= 1
    assert secrets.battery("0f" * 20, 1)[1] < 0.001  # too many runs
    assert secrets.battery("0" * 20 + "f" * 20, 1)[1] < 0.001  # too few
    assert secrets.alphabet_of("0123abcf") == 1 and secrets.ALPHABETS[secrets.alphabet_of("aB1+/")][0] == "base64"


def best_labels(scores, switch):
    """All paths, tried one after the other."""
    best, langs = {(): 0.0}, range(scores.shape[1])
    for row in scores:
        best = {p + (x,): v + row[x] - (switch if p and p[-1] != x else 0) for p, v in best.items() for x in langs}
    return max(best.values())


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(4)
    scores = [draw.normal(0, 3, (n, 3)) for n in (0, 1, 5, 7, 3, 0, 7)]
    for switch in (0.5, 3.0):
        for s, labels in zip(scores, language.viterbi(scores, switch)):
            assert len(labels) == len(s)
            if len(s):
                value = s[np.arange(len(s)), labels].sum() - switch * (np.diff(labels) != 0).sum()
                assert abs(value - best_labels(s, switch)) < 1e-9


def test_language_held_out_and_mixed(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.where(~language.held_out()), "text", "lang")
    got = language.identify(docs.where(language.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    en, de = (docs.where(f"lang = '{x}' and n_chars between 300 and 900").orderBy("doc_id").first().text for x in ("en", "de"))
    rows = [(1, en + "\n" + de), (2, None), (3, " 12 !?"), (4, "привет мир"), (5, "x"), (None, de), (6, "² ½")]
    found = {
        r.doc_id: r
        for r in language.identify(
            spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang_pred string"), model
        ).collect()
    }
    spans = [s for s in found[1].spans if s.end - s.start > 50]
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - len(en)) < 60
    assert (found[2].lang_pred, found[2].score) == (found[3].lang_pred, found[3].score) == ("und", 0.0)
    assert found[6].lang_pred == "und" and found[None].lang_pred == "de"
    assert found[4].lang_pred in model.langs and found[5].lang_pred in model.langs
    empty = language.learn(docs.limit(0), "text", "lang")
    assert [r.lang_pred for r in language.identify(docs.limit(3), empty).collect()] == ["und"] * 3
    assert language.identify(docs.limit(0), model).collect() == []


def test_grams_of_words():
    words = ["Ab", "é", "xyz", "ab"]
    found, starts = language.grams(words)
    ends = [*starts[1:], len(found[0][0]) - 1]

    def of(k):
        return [sorted(b[s:e][ok[s:e]]) for b, ok in found for s, e in [(starts[k], ends[k])]]

    assert [len(x) for x in of(0)] == [2, 3, 2] and [len(x) for x in of(1)] == [1, 2, 1]
    assert [len(x) for x in of(2)] == [3, 4, 3] and of(0) == of(3)
    alone, _ = language.grams(["xyz"])
    assert [sorted(b[:-1][ok[:-1]]) for b, ok in alone] == of(2)


def test_scripts_narrow_the_candidates():
    model = language.Model(["el", "en", "ru"], np.ones((language.BUCKETS, 3)), {("el", "Greek"): 9, ("en", "Latin"): 9, ("ru", "Cyrillic"): 9})
    assert model.score(["λόγος", "word", "слово"]).argmax(1).tolist() == [0, 1, 2]
    assert language.script_of("漢") == "Han" and language.script_of("ß") == "Latin" and language.word_script("²") is None


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body class=page>
<header class="top"><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies, lots of them, on this site to be nice.</div>
<div id=wrap><div class="main"><h2>Title of the piece</h2>
<p>First long paragraph, with commas, and enough text to be scored by the rules.</p>
<div class="ad-box">Buy this now, cheap, very cheap indeed, today only.</div>
<p>Second long   paragraph, with <a href=y>a link</a>, and enough text &amp; more.
<p>Third &lt;one&gt; unclosed,<br>a longer one for good measure, yes.<ul><li>Item one<li>Item two</ul></div>
<aside>Side text, that is long, really long, with commas, and so on.</aside></div>
<form>Name: <input> please, type your long name, here now</form>
<section id="comments"><p>Nice article, I loved it, really, thanks a lot for writing this piece.</p></section>
<footer>Copyright, all rights, reserved by the long company</footer></body></html>"""
MAIN = """Title of the piece
First long paragraph, with commas, and enough text to be scored by the rules.
Second long paragraph, with a link, and enough text & more.
Third <one> unclosed, a longer one for good measure, yes.
Item one
Item two"""


def test_main_text():
    assert main_text(PAGE) == MAIN
    assert main_text("") == "" and main_text("just text & such") == "just text & such"
    assert main_text("<p>a<b") == "a" and main_text("a &am") == "a &am" and main_text("&eacute;&#233;&#xe9") == "ééé"
    assert main_text("<div>" * 3000 + "deep text here, quite deep, really") == "deep text here, quite deep, really"
    assert main_text("<p>" + "a, long word " * 20000) == ("a, long word " * 20000).strip()
    split = "".join(f"<section><p>Part {k}, long enough, and with commas to be scored.</p></section>" for k in range(4))
    assert main_text(f"<body><nav>x</nav><div>{split}</div></body>").count("\n") == 3


def test_pages_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split("</?(?:p|h1)[^>]*>", inner.replace("<br>", " "))
        import html

        clean = (" ".join(html.unescape(re.sub("</?[a-z][^>]*>", "", b)).split()) for b in blocks)
        assert got[r.page_id].text == "\n".join(b for b in clean if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None, "z"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in extract(odd).collect()] == [(None, "", 0), (1, "", 0)]


def test_quality_on_labels_kept_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = learn(docs, labels.where(~hidden))
    got = score(docs, model).join(labels.where(hidden), "doc_id").collect()
    assert len(got) > 60
    assert np.mean([(r.quality_score >= 0.5) == bool(r.quality) for r in got]) > 0.95
    assert np.mean([r.quality_score >= 0.5 for r in got if r.quality]) > 0.98
    odd = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (1, "", "en", None, 0, 2)],
        "doc_id long, text string, lang string, source string, n_chars long, y int",
    )
    assert all(0 <= r.quality_score <= 1 for r in score(odd, model).collect())
    assert [r.quality_score for r in score(odd, learn(odd, labels.limit(0))).collect()] == [1.0] * 3
    assert score(docs.limit(0), model).collect() == []
    assert learn(docs.limit(0), labels).views is None


def test_held_out_is_the_crc(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), language.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
