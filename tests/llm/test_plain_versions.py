"""Digests and document statistics against plain versions, and cases the operators' other tests leave out."""

import hashlib
import math
import random
import re

import pytest

from millrace.llm import digests, packing, quality, warc
from tests.llm.test_operators import docs_of


def texts():
    rng = random.Random(8)
    words = ["the", "The", "of", "naïve", "日本", "🙂", "a", "x1", "END.", "$$", "it's", "1,000", "(see", "below)"]
    own = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    lines = ["\n".join(rng.choice(["same line", "another", " ", "third one."]) for _ in range(9)) for _ in range(5)]
    return [*own, *lines, "", " ", "\n\n", "a", "ab", "abc", "é", "x" * 50_000, "word " * 20_000]


def plain_digest(raw):
    counts = [0] * 256
    for i in range(len(raw) - 2):
        counts[((raw[i] * 65536 + raw[i + 1] * 256 + raw[i + 2]) * 2654435769 % 2**32) // 2**24] += 1
    order = sorted(counts)
    cuts = [order[63], order[127], order[191]]
    codes = [sum(c > q for q in cuts) for c in counts]
    return [min(255, round(math.log(1 + len(raw), 1.1)))], codes


def test_digest_equals_the_plain_one():
    found = {}
    for text in texts():
        raw = text.encode()
        length, codes = plain_digest(raw)
        got = digests.digest(raw)
        assert len(got) == 65 and abs(got[0] - length[0]) <= (abs(math.log(1 + len(raw), 1.1) % 1 - 0.5) < 1e-6)
        assert [got[1 + i // 4] // 4 ** (i % 4) % 4 for i in range(256)] == codes
        found[text] = (got, codes)
    cost = {0: 0, 1: 1, 2: 2, 3: 6}
    several = list(found.values())[::5]
    for a, x in several:
        for b, y in several:
            want = sum(cost[abs(p - q)] for p, q in zip(x, y)) + min(80, 4 * max(0, abs(a[0] - b[0]) - 1))
            assert digests.difference(a, b) == want and digests.likeness(a, b) == max(0, 1 - want / 400)


def plain_statistics(text):
    raw = text.encode()
    chars = [chr(b) for b in raw]  # a byte each
    white = lambda c: c in "\t\n\x0b\x0c\r "
    letter = lambda c: "A" <= c <= "Z" or "a" <= c <= "z" or ord(c) >= 128
    mark = lambda c: c in ".,;:?'\"()-"
    symbol = lambda c: 33 <= ord(c) < 127 and not letter(c) and not mark(c) and not c.isdigit()
    words = [w for w in re.split("[\t\n\x0b\x0c\r ]+", "".join(chars)) if w]
    lines = [x for x in "".join(chars).split("\n") if x.strip("\t\n\x0b\x0c\r ")]
    n, total = len(words), len(chars)
    share = lambda part, whole, usual: math.log((part + 8 * usual) / (max(whole - part, 0) + 8 * (1 - usual)))
    count = lambda f: sum(map(f, chars))
    sizes = list(map(len, words))
    mean = sum(sizes) / n if n else 0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / n) if n else 0
    entropy = -sum(p * math.log2(p) for c in set(chars) for p in [chars.count(c) / total])
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(count(lambda c: "A" <= c <= "Z"), count(letter), 0.03), share(count(symbol), total, 0.003), share(count(mark), total, 0.02),
        share(count(lambda c: "0" <= c <= "9"), total, 0.005), share(count(white), total, 0.15), share(count(lambda c: ord(c) >= 128), total, 0.04), share(len(set(words)), n, 0.8),
        share(max(map(words.count, set(words)), default=0), n, 0.06), share(sum(not letter(w[-1]) for w in words), n, 0.12), share(sum(any(not letter(c) and not mark(c) for c in w) for w in words), n, 0.01),
        share(sum(s <= 3 for s in sizes), n, 0.35), math.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines), 0.02), share(len(pairs) - len(set(pairs)), len(pairs), 0.03),
        entropy, share(sum("A" <= w[0] <= "Z" for w in words), n, 0.12), math.log1p(max(sizes, default=0)),
    ]


def test_statistics_equal_plain_ones():
    for text in texts():
        if len(text) < 60_000:
            assert quality.statistics(text) == pytest.approx(plain_statistics(text), abs=1e-9), text[:40]


def test_quality_of_repeated_and_long_rows(spark):
    rows = [(i, "a plain and honest sentence of words. " * 9 if i % 2 else "$$$ ### BUY " * 20) for i in range(60)]
    rows += [(7, rows[7][1])] * 3 + [(500, "a plain and honest sentence of words. " * 20_000), (500, None), (None, "")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 7}) == 1 and all(0 <= r.score <= 1 for r in got)


def test_warc_of_a_very_long_payload_and_equal_ones(spark):
    long, same = "<p>" + "x y " * 1_000_000, "é" * 600
    rows = [(1, "u", long), (2, "u", long), (3, None, same), (5, "v", same), (4, "v", "short"), (6, "v", "short"), (None, "n", same), (7, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(spark, warc.write_warc(pages)).collect()}
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 5), 5: ("response", None), 4: ("response", None), 6: ("response", None), None: ("response", None), 7: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()) and got[i].payload in (None, raw)


def test_pieces_of_rows_that_repeat_an_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    one = " ".join(f"word{i}" for i in range(700))
    pieces = packing.pack_documents(docs_of(spark, [(300, one), (300, one), (301, "x")]), path, end_id=0, longest=1024, spaces="leading").collect()
    n = len(Tokenizer.from_file(path).encode(one, add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces if p.doc_id == 300) == 2 * n and {p.doc_tokens for p in pieces if p.doc_id == 300} == {n}
    places = [(p.sequence_id, p.offset + i) for p in pieces for i in range(p.length)]
    assert len(set(places)) == len(places)
