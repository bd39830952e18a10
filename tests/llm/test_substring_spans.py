"""Windows of listed stretches are hashed from the words of these alone, and give what whole texts give."""

import numpy as np

from millrace.llm import substring
from millrace.llm.substring import WINDOW, Runs, Words
from millrace.sources.segments import SegmentStore


def test_hashes_of_spans_are_those_of_whole_texts(monkeypatch):
    rng, digested, digests = np.random.default_rng(3), set(), substring._word_digests
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, k)).encode() for k in (0, 300, 19, 80)]
    text, a, n = np.array([1, 1, 3, 1]), np.array([5, 120, 0, 9]), np.array([3, 40, 61, 2])
    whole = Words(texts)
    monkeypatch.setattr(substring, "_word_digests", lambda words: digested.update(words) or digests(words))
    some = Words(texts, (text, a, a + n + WINDOW - 1))
    own = {w for i, x, k in zip(text, a, n, strict=True) for w in texts[i].split()[x : x + k + WINDOW - 1]}
    assert digested == own and some.n < whole.n
    for i, x, k in zip(text, a, n, strict=True):
        for start in whole.first[i] + np.arange(x, x + k):
            for lane in range(2):
                assert whole.hashes(WINDOW, lane)[start] == some.hashes(WINDOW, lane)[some.at[start]]


def test_merged_runs_stay_in_their_buckets(spark, tmp_path):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.shuffle.partitions", "7")
    store = SegmentStore(own, f"file://{tmp_path}/runs")
    runs = Runs(store, "stretches", ["h", "s1", "s2"], 2)
    for k in range(2):
        runs.add(own.range(4000).selectExpr(f"hash((id + {1000 * k}) % 700) * 1L h", f"(id + {1000 * k}) s1", "7L s2", f"id + {10_000 * k} doc", "3 a", "2 n"))
    want = {(r.s1, r.doc) for t in runs.tables()[:1] for r in t.collect()} | {(s1, s1 + 9000) for s1 in range(4000, 5000)}
    runs.compact()
    (merged,) = runs.tables()
    rows = merged.collect()
    assert runs.merges == 1 and len(rows) == len(want) and {(r.s1, r.doc) for r in rows} == want
    # dealt by more than the gram, each task would write a file of each bucket
    assert len(merged.inputFiles()) <= 2 * runs.buckets
    store.remove()
