"""The source audit against plain arithmetic over dense tables; radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_audit(rows, least=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    langs = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        langs[lang].add(source)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: share(groups[lang, s]) for s in sources}
        q = share(sum((groups[lang, s] for s in sources), Counter()))
        differ = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -n, i) for i, (n, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-differ(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -n, i) for i, (n, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "The", "naïve", "日本", "x1y2", "it's", "a-b", "Éa", "éa", "🙂", *[f"w{chr(97 + i)}" for i in range(26)], *[f"same{chr(97 + i)}" for i in range(20)]]
    out = [(None, "en", "a"), ("", None, None), ("12 34 @[`{", "", ""), (None, "fr", "alone"), ("rare words here", "fr", "alone")]
    for _ in range(300):
        source = rng.choice(["a", "a", "a", "b", None, "é", "z"])
        out.append((" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), source))
    out += [("samea sameb samec", "en", "ties")] * 12 + [("word " * 20_000, "en", "long")] * 2
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **options).collect()}


def test_audit_equals_plain_arithmetic(spark, rows, monkeypatch):
    assert got(spark, rows) == plain_audit(rows)
    monkeypatch.setattr(divergence, "SLICE", 1000)
    assert got(spark, rows, least_docs=1, top=3) == plain_audit(rows, 1, 3)


def test_audit_of_nothing_and_of_wide_tables(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows[:60])], SCHEMA)
    clash = ["term", "n", "docs", "v", "p0", "item", "value", "rank", "part", "need", "top", "cut"]
    wide = df.select("*", *[F.lit(1).alias(c) for c in clash])
    assert sorted(map(str, divergence.audit(wide, least_docs=2).collect())) == sorted(map(str, divergence.audit(df, least_docs=2).collect()))


def test_slices_end_between_terms():
    data = b"ab cd" * 500
    parts = list(divergence.slices(data))
    assert b"".join(parts) == data
    whole = re.findall(rb"[a-z\x80-\xff]+", data)
    divergence.SLICE, old = 7, divergence.SLICE
    try:
        assert [t for p in divergence.slices(data) for t in re.findall(rb"[a-z\x80-\xff]+", p)] == whole
    finally:
        divergence.SLICE = old


@pytest.mark.parametrize(("digit", "k"), [(1, 3), (10, 1), (10, 10), (16, 7)])
def test_radix_selection_equals_sorting(spark, digit, k):
    rng = random.Random(digit)
    rows = []
    for g in range(6):
        items = {"".join(rng.choice(["a", "b", "é", "日"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([1, 4, 200]))} | {"prefix" * 5 + c for c in "abcdefghijkl"}
        rows += [(g, i, rng.choice([0, 0, 1, 5, 2**20, 2**40 + 1]) if g else 0) for i in items]
    df = spark.createDataFrame(rows, "g int, item string, value long").cache()
    want = set()
    for g in range(6):
        own = sorted((-v, i.encode(), i) for h, i, v in rows if h == g)[:k]
        want |= {(g, i, -v, n) for n, (v, _, i) in enumerate(own, 1)}
    assert {(r.g, r.item, r.value, r["rank"]) for r in divergence.radix_top(df, ["g"], k, digit).collect()} == want
