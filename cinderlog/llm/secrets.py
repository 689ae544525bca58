"""Secrets in whole texts: fixed forms, and strings a battery of randomness tests finds.

Candidates are runs of at least 20 characters of the base64 alphabets. The alphabet of
each is inferred from its characters (hexadecimal, base32, base64 and the like). Three
tests are computed against "every character is drawn evenly from that alphabet":
Pearson's chi-squared on the character counts, the runs test about the middle of the
alphabet, and the serial correlation of neighbours. Runs and correlation must not reject
evenness. The chi-squared statistic is then held against ordinary text: under the letter
frequencies of the corpus itself, restricted to the alphabet, its mean and variance are
known, and grow with the length, so a short string needs far better evidence than a long
one. The lower tail is the p-value of "this is ordinary text". The step-up procedure of
Benjamini and Hochberg then controls the share of false discoveries within each alphabet
and band of lengths, over all candidates of the table.

Letter frequencies and the histogram of p-values are counted over the whole table. What
reaches the driver is 256 counts and one threshold per alphabet and band.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cinderlog.llm.common import Scratch, in_slices, table

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")

#: Alphabets in the order they are tried: name, characters.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _LOWER.upper()),
    ("base32", _LOWER.upper() + "234567"),
    ("lower36", _DIGITS + _LOWER),
    ("upper36", _DIGITS + _LOWER.upper()),
    ("letters", _LOWER.upper() + _LOWER),
    ("base62", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
    ("base66", _LOWER.upper() + _LOWER + _DIGITS + "+/-_"),
)
#: Numbers are counted, measured and identified evenly without being secret.
NEVER = {"decimal"}
#: Lower ends of the bands of lengths within which discoveries are controlled.
BANDS = (20, 32, 48, 64, 128)
#: Share of false discoveries, and the level at which a test rejects evenness.
FALSE_SHARE, LEVEL = 0.01, 0.001
#: Bins per power of ten of p, and the smallest power told apart.
BINS, FLOOR = 20, 60

_SETS = [frozenset(x) for _, x in ALPHABETS]
_PLACES = [{c: i for i, c in enumerate(x)} for _, x in ALPHABETS]


def alphabet_of(word: str) -> int:
    """The first alphabet that holds all characters of the string."""
    has = set(word)
    return next(k for k, x in enumerate(_SETS) if has <= x)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(word: str, alphabet: int) -> tuple[float, float, float]:
    """(chi-squared, p of the runs test, p of the serial correlation) against evenness."""
    place, n = _PLACES[alphabet], len(word)
    x = np.fromiter(map(place.__getitem__, word), np.int64, n)
    size = len(place)
    counts = np.bincount(x, minlength=size)
    chi = float((counts * counts).sum() * size / n - n)
    high = x >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    runs_p = 0.0
    if n0 and n1:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    y = x - x.mean()
    total = float((y * y).sum())
    serial_p = 0.0
    if total > 0:
        r = float((y[1:] * y[:-1]).sum()) / total
        serial_p = _two_sided((r + 1 / n) * math.sqrt(n))
    return chi, runs_p, serial_p


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _band(length: int) -> int:
    return max(b for b in BANDS if b <= length)


def _scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its base spans and tested candidates. One more row per slice,
    with `letters`: how often each ASCII character occurs in it."""
    found = pa.list_(
        pa.struct(
            [
                ("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.int32()),
                ("chi", pa.float64()), ("runs_p", pa.float64()), ("serial_p", pa.float64()),
            ]
        )
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros(256, np.int64)
        spans, tested = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            counts += np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
            base = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            more = []
            for m in CANDIDATE.finditer(text):
                start, end = m.span()
                if any(s < end and start < e for s, _, e in base):
                    continue
                k = alphabet_of(m[0])
                if ALPHABETS[k][0] in NEVER:
                    continue
                more.append((start, end, k, *battery(m[0], k)))
            tested.append([dict(zip(("start", "end", "alphabet", "chi", "runs_p", "serial_p"), x)) for x in more])
        rows = batch.num_rows
        none = pa.nulls(1, batch.column(0).type)
        ids = pa.concat_arrays([batch.column(0), none])
        base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([*spans, None], base_type),
                pa.array([*tested, None], found),
                pa.array([None] * rows + [counts[:128].tolist()], pa.list_(pa.int64())),
            ],
            ["doc_id", "base", "tested", "letters"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        in_slices(work),
        f"doc_id {kind}, base array<struct<start:long,kind:int,end:long>>, tested array<struct<"
        "start:long,end:long,alphabet:int,chi:double,runs_p:double,serial_p:double>>, letters array<long>",
    )


def text_moments(letters: np.ndarray) -> list[tuple[float, float, float]]:
    """Per alphabet, (a, b, c): the chi-squared statistic of n characters of ordinary text has
    mean a + (n - 1) * b and variance about c * n, from the corpus's letter frequencies."""
    out = []
    for _, chars in ALPHABETS:
        q = letters[[ord(c) for c in chars]].astype(float) + 0.5
        q /= q.sum()
        size = len(chars)
        second = size * float((q**2).sum()) - 1
        # X = size / n * sum(counts²) - n; delta method for the part that grows with n
        spread = 4 * size * size * (float((q**3).sum()) - float((q**2).sum()) ** 2)
        out.append((size - 1.0, second, max(spread, 0.0)))
    return out


def _log_p(chi: np.ndarray, n: np.ndarray, alphabet: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """log10 of the chance that ordinary text is spread as evenly as this or more."""
    a, b, c = moments[alphabet].T
    mean = a + (n - 1) * b
    sd = np.sqrt(2 * a + c * n)
    z = (mean - chi) / sd
    return np.array([_log10_tail(x) for x in z])


def _log10_tail(z: float) -> float:
    """log10 of the upper tail of the normal distribution."""
    if z < 30:
        return math.log10(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))
    return -(z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10)


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    false_share: float = FALSE_SHARE,
) -> DataFrame:
    """(doc_id, spans): one row per row of the table; spans are (start, kind, end).

    Places are code points, the end exclusive, in order of start and then kind. Kinds are
    `assign`, `access`, `hex` and `random`; the last are candidates that overlap none of
    the others. Null and empty texts have no spans; rows that repeat count each time, in
    the false-discovery control too; a null id is kept; an empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    work = Scratch(spark, "secrets")
    scanned = work.table(_scan(df, id_col, text_col), "scanned")

    # 128 sums
    rows = (
        scanned.where("letters is not null")
        .select(F.posexplode("letters").alias("code", "n"))
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    letters = np.zeros(128, np.int64)
    for row in rows:
        letters[row["code"]] = row["n"]
    moments = np.array(text_moments(letters))

    lowest = -FLOOR * BINS

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        chi, n, alphabet, runs, serial = (batch.column(k).to_numpy() for k in range(5))
        log_p = _log_p(chi, n, alphabet, moments)
        # upwards, so that a bin never claims more evidence than its members have
        at = np.maximum(np.ceil(log_p * BINS), lowest).astype(np.int64)
        at[(runs < LEVEL) | (serial < LEVEL)] = 0
        band = np.array([_band(int(x)) for x in n], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(alphabet, pa.int32()), pa.array(band), pa.array(at)], ["alphabet", "band", "bin"]
        )

    one = scanned.where("letters is null").select(F.explode("tested").alias("t"))
    histogram = (
        one.select("t.chi", (F.col("t.end") - F.col("t.start")).alias("n"), "t.alphabet", "t.runs_p", "t.serial_p")
        .mapInArrow(in_slices(bins, 8192), "alphabet int, band long, bin long")
        .groupBy("alphabet", "band", "bin")
        .count()
    )
    # step up within alphabet and band: the largest bin whose p stays below its rank's share
    within = Window.partitionBy("alphabet", "band")
    limits = (
        histogram.withColumn("rank", F.sum("count").over(within.orderBy("bin")))
        .withColumn("all", F.sum("count").over(within))
        .where(F.pow(F.lit(10.0), F.col("bin") / BINS) <= false_share * F.col("rank") / F.col("all"))
        .groupBy("alphabet", "band")
        .agg(F.max("bin").alias("bin"))
        .collect()  # at most alphabets times bands
    )
    limit = {(r["alphabet"], r["band"]): r["bin"] for r in limits}

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for base, tested in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
            found = [(x["start"], x["kind"], x["end"]) for x in base]
            for t in tested:
                n = t["end"] - t["start"]
                most = limit.get((t["alphabet"], _band(n)))
                if most is None or t["runs_p"] < LEVEL or t["serial_p"] < LEVEL:
                    continue
                log_p = _log_p(np.array([t["chi"]]), np.array([n]), np.array([t["alphabet"]]), moments)[0]
                if max(math.ceil(log_p * BINS), lowest) <= most:
                    found.append((t["start"], 3, t["end"]))
            out.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(found)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))],
            ["doc_id", "spans"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return (
        scanned.where("letters is null")
        .select("doc_id", "base", "tested")
        .mapInArrow(in_slices(spans, 2048), f"doc_id {kind}, spans array<struct<start:long,kind:string,end:long>>")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    many = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        many("assign").alias("n_assign"),
        many("access").alias("n_access"),
        many("hex").alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        many("random").alias("n_random"),
    )
