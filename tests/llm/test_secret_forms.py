"""The registered columns of op3 over whole tables, against the contract's patterns applied by
another engine of regular expressions, and the added spans against what they may be."""

import hashlib

import numpy as np
import pytest
import regex

from cinderlog.llm import secrets

KINDS = ("assign", "access", "hex", "random")
FORMS = (
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def forms(text):
    found = []
    for kind, (pattern, holds) in enumerate(FORMS):
        compiled = regex.compile(pattern, regex.V0 | regex.ASCII)
        found += [(m.start(), kind, m.end()) for m in compiled.finditer(text) if holds(m)]
    return sorted(found)


def shown(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def candidates(text):
    """Runs of at least 20 characters of the base64 alphabets, letter by letter."""
    inside = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    at, out = 0, []
    while at < len(text):
        end = at
        while end < len(text) and text[end] in inside:
            end += 1
        if end - at >= 20:
            out.append((at, end))
        at = end + 1
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_the_whole_table(spark, size):
    folder = f"/root/testdata/sf{size}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = secrets.op3_secrets(spark, folder).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(texts)
    tested, kept = [], set()
    for r in rows:
        text = texts[r.doc_id]
        base = forms(text)
        assert [sum(k == n for _, k, _ in base) for n in range(3)] == [r.n_assign, r.n_access, r.n_hex]
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and [x for x in spans if x[1] < 3] == base
        apart = [(s, e) for s, e in candidates(text) if not any(s < b_e and b_s < e for b_s, _, b_e in base)]
        added = {(s, e) for s, k, e in spans if k == 3}
        assert added <= set(apart) and len(added) == r.n_random
        kept |= {(r.doc_id, *x) for x in added}
        tested += [(r.doc_id, s, e, text[s:e]) for s, e in apart if not text[s:e].isdigit()]
    check_discoveries("".join(texts.values()), tested, kept)


def check_discoveries(everything, tested, kept):
    """The step-up procedure on unrounded chances; what the query rounds may cost a string
    right at the limit, and adds none."""
    letters = np.bincount([ord(c) for c in everything if ord(c) < 128], minlength=128)
    moments, groups = secrets.text_moments(letters), {}
    for doc, start, end, word in tested:
        k = secrets.alphabet_of(word)
        chi, runs, serial = secrets.battery(word, k)
        a, b, c = moments[k]
        n = len(word)
        z = (a + (n - 1) * b - chi) / (2 * a + c * n) ** 0.5
        uneven = runs < secrets.LEVEL or serial < secrets.LEVEL
        log_p = 0.0 if uneven else secrets._log10_tail(z)
        band = max(x for x in secrets.BANDS if x <= n)
        groups.setdefault((k, band), []).append((log_p, uneven, (doc, start, end)))
    for group in groups.values():
        group.sort()
        log_share = [np.log10(secrets.FALSE_SHARE * (i + 1) / len(group)) for i in range(len(group))]
        last = max((i for i, (p, _, _) in enumerate(group) if p <= log_share[i]), default=-1)
        limit = group[last][0] if last >= 0 else -np.inf
        for log_p, uneven, where in group:
            if where in kept:
                assert log_p <= limit and not uneven
            elif not uneven:
                assert log_p > limit - 2 / secrets.BINS
