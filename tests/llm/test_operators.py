"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import digests, encoding, exact, mixing, packing, pii, quality, simhash, substring, token_files, warc
from millrace.llm.components import components
from millrace.llm.shared import shared_folder

tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = tokenizers.path("word_bpe_49k.json"), tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=SCHEMA):
    """Rows of (id, text[, source]) as documents."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], schema)


@pytest.fixture(scope="module")
def odd():
    """Ids with gaps and out of order; a null id; nulls, empty, blank, long and repeated texts."""
    rng = random.Random(3)
    words = ["the", "The", "of", "naïve", "日本", "🙂", "a", "x1", "<|endoftext|>", "it's", "\x85", "x\x1cy"]
    rows = [(9, None), (4, ""), (7, "  \t\n "), (2, "one"), (3, "One  TWO\nthree"), (12, "one two three"), (5, " ".join(rng.choice(words) for _ in range(30_000))), (None, "no id here"), (None, None), (15, "word " * 3000), (16, "word " * 3000)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(300, "the same text twice"), (300, "the same text twice")]
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_pii_equals_the_plain_patterns(spark, odd):
    rng = random.Random(5)
    card = lambda n: next(s for s in (f"{p}{x}" for p in [rng.randrange(10 ** (n - 2), 10 ** (n - 1))] for x in range(10)) if luhn(s))
    parts = ["a", "é", "🙂", "@", "b@c.de", "x@y", ".", " ", "-", "+", "1", "12", "255.1.2.3", "+1 (919) 555-4584", "(", card(13), card(16), card(19), "0001.2.3.4", "999.1.1.1", "_", "  ", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    texts += ["1" * 5000, "1 " * 20000, "a" * 50000 + "@b.co", "a@b.co " * 2000, "+" + "1(" * 9000, *[t for _, t in odd]]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert [(s.start, s.rank, s.kind, s.end) for s in got[i].base] == base_spans(text or "")
        assert all((text or "")[s.start : s.end] == s.text for s in got[i].spans) and len(got[i].spans) >= len(got[i].base)


def test_pii_context_and_checksums(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB83 WEST 1234 5698 7654 32", "my SSN 123-45-6789", "123-45-6789", "call (919) 555-4584", "see (919) 555-4584", "phone +1 (919) 555-4584", ""]
    got = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in pii.find_pii(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got[0] == [("iban", "GB82 WEST 1234 5698 7654 32")] and got[1] == [] and got[2] == [("ssn", "123-45-6789")] and got[3] == []
    assert got[4] == [("tel", "(919) 555-4584")] and got[5] == [] and got[6] == [("phone", "+1 (919) 555-4584")] and got[7] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, list(enumerate(texts)))).collect()}
    assert clean[4] == "call [tel]" and clean[3] == texts[3]
    assert pii.find_pii(empty(spark)).count() == 0


# 2


def test_quality_tells_junk(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "the", "of", "and", "Morning"]) for _ in range(80)) + "."
    junk = lambda: " ".join(rng.choice(["$$$", "BUY!!", "x9##", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 3 else junk()) for i in range(400)] + [(1000, None), (1001, ""), (None, good())]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(7, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert quality.keep_good(docs_of(spark, rows), labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.score == 0.5 for r in quality.classify(docs_of(spark, rows[:5]), labels.where("false")).collect())
    assert quality.classify(empty(spark), labels).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " ", "\n", "é", "a" * 10**5))


def test_quality_mahalanobis():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (400, 3))
    n, sums, products = np.array([500.0, 400.0]), np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b])
    model = quality.fitted(n, sums, products, to_pooled=0, to_diagonal=0, temperature=1, few_rows=0)
    x = rng.normal(size=(20, 3))
    logs = []
    for rows, own in ((a, 500), (b, 400)):
        cov = np.cov(rows.T, bias=True)
        scatter = np.cov(a.T, bias=True) * 500 / 900 + np.cov(b.T, bias=True) * 400 / 900
        cov = cov + np.diag(1e-6 + 1e-3 * np.diag(scatter))
        z = x - rows.mean(0)
        logs.append(np.log(own / 900) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-6)


# 3


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(spark, odd):
    got = simhash.near_duplicates(docs_of(spark, odd)).collect()
    assert len(got) == len(odd)
    texts = {i: t for i, t in odd if i is not None}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = classes(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [1, 32, 10_000])
def test_simhash_links_are_exact_for_any_bucket(spark, bucket):
    rng = random.Random(3)
    centres, points = [rng.getrandbits(64) for _ in range(25)], set()
    for _ in range(1200):
        x = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        points.add(x)
    points = sorted(points)
    rng.shuffle(points)
    array = np.array(points, np.uint64)
    linked = [(i, int(j)) for i in range(len(points)) for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 2)[0] if i < j]
    want = classes(range(len(points)), linked)
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(points)], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.links(df, bucket)).collect()}
    assert all(got.get(i, i) == want[i] for i in range(len(points)))


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4


def test_mixing_meets_targets(spark, odd):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "x", "tiny"), (None, "y y", "b"), (5000, "same", "b"), (5000, "same", "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    sizes, taken, target = {}, {}, {}
    for r in got:
        if r.doc_id is None:
            continue
        s = source[r.doc_id]
        sizes[s], target[s] = r.source_size, r.target
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert target["tiny"] == pytest.approx(3 * sizes["tiny"]) and all(target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)  # below the next size that a class offers
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and key
    copies = mixing.mixed_documents(docs_of(spark, rows[:900]))
    assert copies.columns == ["doc_id", "text", "lang", "source", "n_chars"] and copies.count() == sum(r.copies for r in mixing.mix(docs_of(spark, rows[:900])).collect())
    assert mixing.mix(empty(spark)).count() == 0 and all(r.taken == 0 for r in mixing.mix(docs_of(spark, [(1, None), (2, " ")])).collect())


def plain_rates(sizes, target, cap):
    """Rates that balance entropy, by halving the multiplier's bracket."""
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        rates = np.minimum(cap, np.exp(np.minimum(mid * sizes, 50)))
        low, high = (mid, high) if (rates * sizes).sum() < target else (low, mid)
    return rates


def test_mixing_rates_balance_entropy(spark):
    rng = np.random.default_rng(6)
    sizes = {"a": rng.integers(1, 40, 300), "b": rng.lognormal(4, 1, 200).astype(int) + 1, None: np.array([3, 3, 9000]), "full": np.array([2, 2, 5]), "empty": np.array([0])}
    goals = {"a": 0.4, "b": 1.9, None: 0.7, "full": 3.0, "empty": 0.0}
    cells = spark.createDataFrame([(k, int(x), int((v == x).sum())) for k, v in sizes.items() for x in np.unique(v)], "source string, size long, _n long")
    sources = spark.createDataFrame([(k, int(v.sum()), goals[k] * float(v.sum())) for k, v in sizes.items()], "source string, source_size long, target double")
    found = mixing.tilts(cells, sources, 3)
    assert found.count() == 5
    got = cells.join(found, cells["source"].eqNullSafe(found["source"])).select(cells["source"], "size", (mixing.rate_units(F.col("size"), F.col("tilt"), 3) / mixing.UNIT).alias("rate")).collect()
    for k, v in sizes.items():
        rates = {r.size: r.rate for r in got if r.source == k}
        want = plain_rates(v.astype(float), goals[k] * v.sum(), 3) if k not in ("full", "empty") else np.full(len(v), 3.0 if k == "full" else 0.0)
        assert [rates[x] for x in v] == pytest.approx(want.tolist(), abs=2e-6)
    assert len({r.rate for r in got if r.source == "a"}) > 20  # they differ within a source


def test_mixing_long_and_repeated_rows(spark):
    rows = [(1, "w " * 200_000, "a"), (2, "x y z", "a"), (2, "x y z", "a"), (None, "x y z", "a"), (None, "x y z", "b"), (64, "q", "b"), (128, "q", "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 3), (0, 3), (1, 200_000), (2, 3), (2, 3), (64, 1), (128, 1)]
    assert {r.taken // r.size for r in got if r.doc_id in (64, 128) or (r.doc_id is None and r.source_size == 5)} == {3}  # the target of b is three times its size
    assert sum(r.taken for r in got if r.source_size == 200_009) == pytest.approx(200_014 - 15, abs=200_000)


def test_word_count(spark, odd):
    got = docs_of(spark, odd).select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in got)


# 5


def plain_removal(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.fixture
def small_batches(spark):
    """Python workers get three rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("batches", "fan_out", "hot_least"), [(1, 4, 512), (3, 2, 512), (5, 2, 4), (2, 4, 2)])
def test_substring_equals_brute_force(spark, odd, small_batches, batches, fan_out, hot_least):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "a", f"x{rng.randint(0, 400)}"])
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 25, 60]))] for _ in range(10)]
    rows = [(i, t) for i, t in odd if i is not None and i != 300]
    for i in range(200):
        text = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            text += rng.choice(passages) if kind < 0.4 else rng.choice(passages)[rng.randint(0, 10) :] if kind < 0.5 else ["z"] * rng.choice([5, 25, 70]) if kind < 0.55 else ["y", "z"] * rng.choice([5, 25]) if kind < 0.6 else [word() for _ in range(rng.randint(0, 60))]
        rows.append((1000 + i * 7 % 201, " ".join(text)))
    want = plain_removal(rows)
    df = docs_of(spark, [*rows, (None, "word " * 3000), (None, None)]).repartition(5)
    got = substring.drop_repeats(df, batches=batches, fan_out=fan_out, hot_least=hot_least).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id is not None} == want
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None) == [(0, 0), (3000, 0)]


def test_substring_compares_words(spark):
    """Words whose polynomial hashes modulo 2^64 are equal whatever the base (Thue and Morse) are different words."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other, rest = one.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(19))
    got = substring.drop_repeats(docs_of(spark, [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 20}


def test_substring_keeps_what_only_hashes_alike(spark):
    """Proposals whose words differ are refused by the digests of the words."""
    text = " ".join(f"w{i}" for i in range(30))
    index = substring.SubstringIndex(docs_of(spark, [(1, text), (2, text), (3, text.replace("w7", "x"))]))
    claims = spark.createDataFrame([(2, 0, 20, 1, 0), (2, 5, 25, 1, 5), (3, 0, 20, 1, 0), (3, 8, 22, 2, 8)], "doc long, a int, n int, f long, fa int")
    assert {r._id: (r.n_words, r.n_removed, r.kept_text) for r in index.without(claims).collect()} == {1: (30, 0, text), 2: (30, 30, ""), 3: (30, 22, "w0 w1 w2 w3 w4 w5 w6 x")}


def test_substring_runs_are_merged_in_levels(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randint(0, 9999)) for _ in range(60))) for i in range(80)]
    index = substring.SubstringIndex(docs_of(spark, rows), fan_out=2)
    for k in range(5):
        index.ingest(F.col("doc").between(16 * k, 16 * k + 15))
    assert index.stretches.merges >= 3 and len(index.stretches.sizes) <= 3
    index.close()
    assert not index.stretches.sizes


def test_substring_repeated_rows_and_empty(spark, small_batches):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (1, text), (1, text), (2, text), (3, text), (1, text)]
    for one in (rows, rows[::-1]):
        got = substring.drop_repeats(docs_of(spark, one).coalesce(1)).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 5 + [(2, 40), (2, 40), (3, 40)]
    unlike = [(1, text), (1, f"z {text} {text}"), (2, text), (1, "short")]
    assert substring.drop_repeats(docs_of(spark, unlike)).count() == 4
    assert substring.drop_repeats(empty(spark)).count() == 0


# 6 and 10


def plain_ids(path, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize(("path", "spaces"), [(WORD, "dropped"), (BYTE, "leading"), (BYTE, "whole")])
def test_chunks_equal_whole_texts(path, spaces, monkeypatch):
    monkeypatch.setattr(encoding, "CHUNKS_KEPT", 50)
    from tokenizers import Tokenizer

    rng, whole = random.Random(1), Tokenizer.from_file(path)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "\x1c", "!", "'s", "23", "<|endoftext|>", "<|startoftext|>", "\0", "​", "　", "\xa0", "日本", "🙂", " x", "<|"]
    own = encoding.Chunks(path, spaces)
    for _ in range(6):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(250)] + ["", " ", "\n", " a", "a "]
        ids, n = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    lengths = [1, 0, 7, 5000, 3]
    ids = rng.integers(0, 2**bits, sum(lengths), dtype=np.uint64).astype(np.uint32)
    file = token_files.TokenFile(raw=b"".join(token_files.serialise([1, 2, 3, 4, 5], lengths, ids, bits, block_ids=100)))
    at = np.cumsum([0, *lengths])
    assert all((file.document(k) == ids[at[k] : at[k + 1]]).all() for k in range(5)) and (file.ids(150, 333) == ids[150:333]).all()


def test_token_files_round_trip(spark, odd):
    files = token_files.write_token_files(docs_of(spark, odd), WORD, end_id=2, spaces="dropped")
    got = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i or 0))
    texts, at = {i: t for i, t in odd if i is not None}, 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        assert r.doc_id is None or ids == plain_ids(WORD, texts[r.doc_id], 2)
        at += len(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(empty(spark), WORD, 2)).count() == 0
    with pytest.raises(ValueError):
        token_files.TokenFile(raw=b"x" * 100)


def test_packing_by_powers_of_two(spark, odd):
    got = packing.pack_documents(docs_of(spark, odd).repartition(3), BYTE, end_id=0, spaces="leading").collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in got)
    for length in {r.length for r in got}:
        assert sorted(r.sequence_id >> 6 for r in got if r.length == length) == list(range(sum(r.length == length for r in got)))
    texts = {i: t for i, t in odd if i is not None and i != 300}
    for i, t in texts.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = plain_ids(BYTE, t, 0)
        assert b"".join(bytes(r.tokens) for r in own) == np.array(ids, "<u4").tobytes() and [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and all(r.doc_tokens == len(ids) for r in own)
    assert packing.binary_pieces(2051, 1024) == [1024, 1024, 2, 1] and packing.pack_documents(empty(spark), BYTE, 0).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty(spark), BYTE, 0, longest=1000)


# 7


def test_warc_round_trip(spark):
    page = "<p>é" + "x" * 1500
    rows = [(1, "http://a/ b\n", page), (5, "http://b", page), (3, None, page), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "n", page), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(spark, warc.write_warc(df.repartition(3))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == hashlib.sha1(raw).hexdigest()
        assert by[i].payload is None if by[i].record_type == "revisit" else bytes(by[i].payload) == raw
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {1: 5, 3: 5, 9: 10} and by[1].url == "http://a/%20b%0A"
    assert warc.read_warc(spark, warc.write_warc(df.where("false"))).count() == 0


def test_warc_reader_finds_damage():
    import io

    good = warc.page_record(1, "u", b"x" * 100, None, "2000-01-01T00:00:00Z")
    assert len(list(warc.pages_of(io.BytesIO(good * 3)))) == 3
    raw = zlib.decompress(good, 31)
    pack = lambda b: (lambda p: p.compress(b) + p.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (raw.replace(b"xxx", b"xyx"), raw[:-3], raw.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.WarcError):
            list(warc.pages_of(io.BytesIO(pack(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.pages_of(io.BytesIO(good[:-20])))


# 8


def test_edited_digests_equal_brute_force(spark, odd):
    rows = [(i, t) for i, t in odd if i is not None and i != 300]
    got = {r.doc_id: r for r in digests.edited_digests(docs_of(spark, rows).repartition(4)).collect()}
    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = (text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()
        own, r = digests.digest(text.encode()), got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited).hexdigest(), own.hex(), digests.digest(edited).hex())
        assert r.near_edited == digests.likeness(own, digests.digest(edited)) and r.near_next == digests.likeness(own, digests.digest(after.encode()))
    single = digests.edited_digests(docs_of(spark, [(1, "abcdef")])).first()
    assert single.near_next == 1 and single.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert digests.edited_digests(docs_of(spark, odd)).count() == len(odd) and digests.edited_digests(empty(spark)).count() == 0
    assert digests.likeness(own, own) == 1 and digests.digests(docs_of(spark, odd)).count() == len(odd)


# 9


def test_exact_equals_brute_force(spark, odd):
    rows = [r for r in odd if r[0] != 300] + [(400, "a  b"), (401, "a\tb"), (402, "a b "), (403, "x" * 200 + "1"), (404, "x" * 200 + "2"), (405, "x" * 200 + "1")]
    got = exact.exact_groups(docs_of(spark, rows), digest_all=True).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = sorted((str(i), str(min((x for x in ids if x is not None), default=None)), len(ids), i == min((x for x in ids if x is not None), default=None), hashlib.sha256(n.encode()).hexdigest()) for n, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    left = exact.drop_exact_duplicates(docs_of(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in left.collect()} == {i for i, _ in rows if i is None} | {min(x for x in ids if x is not None) for ids in groups.values() if any(x is not None for x in ids)}
    assert exact.exact_groups(empty(spark)).count() == 0


# All


def test_other_columns_don_t_matter(spark):
    """Columns whose names the operators use inside, or that differ from them by case."""
    clash = ["_id", "_text", "_x", "h", "seg", "doc", "node", "fp", "size", "target", "part", "kept", "spans", "base", "score", "start", "length"]
    rows = docs_of(spark, [(1, "one two three four"), (2, "one two three four"), (3, None)])
    wide = rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (
        pii.find_pii, lambda d: quality.classify(d, labels), simhash.near_duplicates, mixing.mix, substring.drop_repeats, lambda d: token_files.read_token_files(spark, token_files.write_token_files(d, WORD, 2)),
        lambda d: warc.read_warc(spark, warc.write_warc(d, id_col="doc_id", url_col="source", html_col="text")), digests.edited_digests, exact.exact_groups, lambda d: packing.pack_documents(d, BYTE, 0),
    ):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(rows).collect()))
    for keep in (exact.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: quality.keep_good(d, labels), mixing.mixed_documents):
        assert set(keep(wide).columns) == set(wide.columns) and keep(wide).count() == keep(rows).count()


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
