"""Language identification of whole texts, spans of mixed language included.

Learning: letter n-grams of the words of labelled documents are counted per language,
hashed into a fixed number of buckets, and smoothed into log-probabilities; the letters of
each language are also counted by script. All labelled rows are counted; tasks count their
own rows first, so that what is shuffled and what the model holds is bounded by the buckets
and the number of languages.

Prediction: the script of a word's letters leaves only the languages written in it. If one
is left, the word is its; else each candidate gets the summed log-probability of the
word's n-grams. Viterbi's algorithm then labels the words of a text with the sequence of
languages of the highest total score, less a penalty for every switch, so a foreign word
or name doesn't break a span but a foreign sentence does. The language of a text is that
of the most letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.llm.common import SLICE, in_slices, table, texts

#: Hash buckets of n-grams; the model holds one number per bucket and language.
BUCKETS = 1 << 16
#: Lengths of n-grams; words are padded with a space at both ends.
GRAMS = (1, 2, 3)
#: Cost, in natural logs, of changing the language between two words.
SWITCH = 12.0
#: A script belongs to a language if it makes up this share of its letters.
SCRIPT_SHARE = 0.01
#: Words remembered per Python worker.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges, and their names.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Other"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"),
    (0xFF21, "Latin"), (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0x10000, "Other"),
    (0x20000, "Han"),
)
_STARTS = [x for x, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def word_script(word: str) -> str | None:
    """The script of most letters of a word; None if it has no letter."""
    if word.isalpha() and max(word) < "\u0370":
        return "Latin"
    seen = Counter(script_of(c) for c in word if c.isalpha())
    return min(seen, key=lambda s: (-seen[s], s)) if seen else None


def grams(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash buckets of the letter n-grams of words in lower case, a space at both ends.

    For every n, (buckets, valid) of the n-gram that starts at each place of the words
    joined by spaces; and the place where each word starts. A space alone and what reaches
    into the next word aren't valid.
    """
    text = " " + " ".join(words).lower() + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = code == 32
    starts = np.flatnonzero(space)[:-1]
    code = np.concatenate([code, np.zeros(max(GRAMS), np.uint64)])
    size, out, mixed = len(space), [], np.zeros(len(space), np.uint64)
    inside = np.concatenate([~space, [False] * max(GRAMS)])
    valid = np.ones(size, bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            mixed = (mixed + code[n - 1 : n - 1 + size] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            if n > 2:
                valid = valid & inside[n - 2 : n - 2 + size]  # no space before the last letter
            if n in GRAMS:
                out.append(((mixed % np.uint64(BUCKETS)).astype(np.int64), ~space if n == 1 else valid.copy()))
    for _, ok in out:
        ok[-1] = False  # the last space begins no word
    return out, starts


def learn(df: DataFrame, text_col: str, lang_col: str) -> "Model":
    """The model of all rows with a language. Rows with null text teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        totals: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()

        def settle() -> None:
            for lang, seen in words.items():
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                real = [(w, n, script) for w, n in seen.items() if (script := word_script(w))]
                for w, n, script in real:
                    scripts[lang, script] += n * len(w)
                if real:
                    found, starts = grams([w for w, _, _ in real])
                    many = np.repeat([n for _, n, _ in real], np.diff([*starts, len(found[0][0]) - 1]))
                    for bucket, valid in found:
                        got = np.bincount(bucket[:-1][valid[:-1]], many[valid[:-1]], BUCKETS)
                        totals[lang] += got.astype(np.int64)
            words.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for text, lang in zip(texts(part.column(0)), part.column(1).to_pylist()):
                    words[lang].update(WORD.findall(text))
                if sum(map(len, words.values())) > REMEMBERED:
                    settle()
        settle()
        rows = [(lang, None, int(g), int(t[g])) for lang, t in totals.items() for g in np.flatnonzero(t)]
        rows += [(lang, script, None, n) for (lang, script), n in scripts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))],
            ["lang", "script", "gram", "n"],
        )

    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # at most buckets + scripts rows per language
    rows = (
        labelled.select(text_col, lang_col)
        .mapInArrow(count, "lang string, script string, gram int, n long")
        .groupBy("lang", "script", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pydict()
    )
    langs = sorted(set(rows["lang"]))
    at = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    letters: Counter = Counter()
    for lang, script, gram, n in zip(rows["lang"], rows["script"], rows["gram"], rows["n"]):
        if gram is None:
            letters[lang, script] += n
        else:
            counts[gram, at[lang]] += n
    return Model(langs, counts, letters)


class Model:
    """Log-probabilities by bucket and language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: Counter):
        self.langs = langs
        total = counts.sum(0) if langs else np.zeros(0)
        self.logs = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32) if langs else counts
        all_letters: Counter = Counter()
        for (lang, _), n in letters.items():
            all_letters[lang] += n
        self.scripts: dict[str, list[int]] = defaultdict(list)
        for k, lang in enumerate(langs):
            for (other, script), n in letters.items():
                if other == lang and n >= SCRIPT_SHARE * all_letters[lang]:
                    self.scripts[script].append(k)
        self.default = int(np.argmax(total)) if langs else 0

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of words per language, the best 0; all 0 for words without a letter.

        A script that no language uses leaves all candidates and tells nothing.
        """
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        found, starts = grams(words)
        for bucket, valid in found:
            out += np.add.reduceat(self.logs[bucket] * valid[:, None], starts, dtype=np.float64)
        by_script: dict[str | None, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            by_script[word_script(word)].append(k)
        for script, rows in by_script.items():
            candidates = self.scripts.get(script, [])
            if not candidates:
                out[rows] = 0.0
                continue
            ruled = np.setdiff1d(np.arange(len(self.langs)), candidates)
            low = out[np.ix_(rows, candidates)].min(1)
            out[np.ix_(rows, ruled)] = low[:, None] - 2 * SWITCH
        return out - out.max(1, keepdims=True)


class _Words(dict):
    """Rows of a table of word scores, by word; row 0 is for words without letters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.start()

    def start(self) -> None:
        self.clear()
        self.scores = np.zeros((1, len(self.model.langs)))
        self.letters = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        """Adds the words that aren't there yet."""
        new = []
        for word in words.difference(self):
            if word_script(word) is None:
                self[word] = 0
            else:
                self[word] = len(self.scores) + len(new)
                new.append(word)
        if new:
            self.scores = np.concatenate([self.scores, self.model.score(new)])
            self.letters = np.concatenate([self.letters, [len(w) for w in new]])


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """For each text, given as scores by word and language, the best label of every word.

    The texts advance together, longest first, so a step costs one operation on all that
    still have words. Ties go to staying, then to the language named first.
    """
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    if not len(lengths) or not lengths[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    langs = scores[order[0]].shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([scores[k] for k in order])
    # how many texts still have a word at each step
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    came = np.zeros((len(flat), langs), np.int8 if langs < 128 else np.int32)
    best = np.zeros((len(order), langs))
    ids = np.arange(langs, dtype=came.dtype)
    for t in range(lengths[0]):
        n = alive[t]
        now = best[:n]
        at = starts[:n] + t
        if t:
            top = now.argmax(1)
            jump = now[np.arange(n), top] - switch
            moved = jump[:, None] > now
            came[at] = np.where(moved, top[:, None].astype(came.dtype), ids)
            now = np.where(moved, jump[:, None], now)
        now = now + flat[at]
        best[:n] = now - now.max(1, keepdims=True)
    out = np.zeros(len(flat), np.int64)
    state = best.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]
    labels: list[np.ndarray] = [None] * len(scores)  # type: ignore[list-item]
    for k, start, length in zip(order, starts, lengths):
        labels[k] = out[start : start + length]
    return labels


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans): one row per row of the table.

    `spans` are (start, end, lang), in code points, from the first to past the last word of
    a run of words with one label. `lang_pred` is the language of most letters, the first
    by name if several have as many; `score` is its share of the letters. A text that is
    null or has no letter is `und`, with score 0 and no span, as is every text if nothing
    was learned. Rows that repeat get the same result each; a null id is kept; other columns
    are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by buckets and languages
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = _Words(model) if model.langs else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if words is not None and len(words) > REMEMBERED:
                words.start()
            whole = texts(batch.column(1))
            found = [WORD.findall(text) for text in whole] if words is not None else [[]] * len(whole)
            rows = []
            if words is not None:
                words.learn(set().union(*found))
            for own in found:
                code = np.fromiter(map(words.__getitem__, own), np.int64, len(own)) if own else np.zeros(0, np.int64)
                rows.append(code[code > 0])
            labels = viterbi([words.scores[r] for r in rows], switch) if words is not None else rows
            preds, shares, spans = [], [], []
            for text, code, label in zip(whole, rows, labels):
                if not len(label):
                    preds.append("und"), shares.append(0.0), spans.append([])
                    continue
                letters = np.bincount(label, words.letters[code], len(model.langs))
                top = int(letters.argmax())
                preds.append(model.langs[top])
                shares.append(float(letters[top] / letters.sum()))
                places = [m.span() for m in WORD.finditer(text) if words[m[0]]]
                cut = np.flatnonzero(np.diff(label)) + 1
                first = np.concatenate([[0], cut])
                last = np.concatenate([cut, [len(label)]]) - 1
                spans.append(
                    [
                        {"start": places[a][0], "end": places[b][1], "lang": model.langs[int(label[a])]}
                        for a, b in zip(first, last)
                    ]
                )
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

        # a step of Viterbi costs the same for one text as for many
        yield from in_slices(work, 4096, 1)(batches)

    return df.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    )


def held_out(id_col: str = "doc_id"):
    """One document in five, by its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()), "text", "lang")
    return identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )
