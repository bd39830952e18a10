"""Sources that grow, folds in order of event time, and table functions."""

import io
import json
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import parsing, table_functions
from millrace.sources import live
from millrace.streaming import ordered, streams


@pytest.fixture(scope="module")
def live_spark(spark):
    live.register(spark)
    table_functions.register(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    return spark


def drained(stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@pytest.mark.parametrize("part", [7, 64, 1 << 20])
def test_lines_of_any_range_are_read_once(live_spark, tmp_path, part):
    lines = ["", "a", "é🙂" * 5, "x" * 300, " ", "last with end", "\r", "cr\r"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_bytes("\n".join(lines).encode() + b"\nno end yet")
    (tmp_path / "in/two.txt").write_bytes(b"")
    (tmp_path / "in/three.txt").write_bytes(b"only\n")
    (tmp_path / "in/_hidden").write_bytes(b"no\n")
    got = live_spark.read.format("growing_lines").option("path", str(tmp_path / "in")).option("part", part).load().collect()
    assert sorted((r.file, r.line) for r in got) == sorted([("one.txt", x.removesuffix("\r")) for x in lines] + [("three.txt", "only")])
    whole = (tmp_path / "in/one.txt").read_bytes()
    assert all(whole[r.at :].startswith(r.line.encode()) for r in got if r.file == "one.txt")


def test_a_stream_of_lines_goes_on_where_it_ended(live_spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = lambda: live_spark.readStream.format("growing_lines").option("path", str(folder)).option("part", 50).load()
    wanted = Counter()
    for step in range(4):
        for name in ("a.jsonl", "b.jsonl")[: 1 + step % 2]:
            with (folder / name).open("a") as f:
                for i in range(30):
                    f.write(json.dumps({"k": f"{name}-{step}-{i}"}) + "\n")
                    wanted[f"{name}-{step}-{i}"] += 1
                f.write('{"k": "half')  # a line that is being written
                half = f"half{name}{step}"
        got = drained(live.parsed_lines(stream(), "k string"), tmp_path)
        assert Counter(r.k for r in got.collect()) == wanted
        for name in ("a.jsonl", "b.jsonl")[: 1 + step % 2]:
            with (folder / name).open("a") as f:
                f.write(half.removeprefix("half") + name + '"}\n')
            wanted["half" + half.removeprefix("half") + name] += 1
    got = drained(live.parsed_lines(stream(), "k string"), tmp_path)
    assert Counter(r.k for r in got.collect()) == wanted


def test_lines_that_arent_json(live_spark):
    rows = live_spark.createDataFrame([('{"a": 1, "b": "x"}',), ("",), ("  ",), ("{broken",), ('{"b": null}',), ("[1]",)], "line string")
    got = live.parsed_lines(rows, "a int, b string").collect()
    assert sorted(map(str, ((r.a, r.b, r.malformed) for r in got if not r.malformed))) == sorted(map(str, [(1, "x", False), (None, None, False)])) and sum(r.malformed for r in got) == 2


def chat(i, **changes):
    return {"role_1": f"Doctor{i % 2}_RoleType.ASSISTANT", "role_2": "Nurse_RoleType.USER", "original_task": f"task {i}", "specified_task": "more", "message_1": "hi", "message_12": "bye", "other": "x"} | changes


def test_zipped_chats_as_table_and_stream(live_spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def archive(name, chats):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("sub/", "")
            for i, c in chats.items():
                z.writestr(f"sub/chat_{i}.json", c if isinstance(c, str) else json.dumps(c))
        (folder / name).write_bytes(data.getvalue())

    archive("2024-01.zip", {i: chat(i) for i in range(7)} | {90: chat(90, role_1="_RoleType.ASSISTANT"), 91: chat(91, role_2="Nurse"), 92: chat(92, original_task=""), 93: "not json", 94: "{}", 95: chat(95, specified_task="")})
    load = lambda: live_spark.read.format("zipped_files").option("path", str(folder)).option("members", 3).load()
    got = live.parsed_chats(load()).collect()
    assert sorted(r.original_task for r in got) == [f"task {i}" for i in range(7)] and {r.assistant_role for r in got} == {"Doctor0", "Doctor1"} and {r.user_role for r in got} == {"Nurse"}
    assert all(r.messages == {1: "hi", 12: "bye"} for r in got)
    stream = lambda: live.parsed_chats(live_spark.readStream.format("zipped_files").option("path", str(folder)).option("members", 2).load()).select("original_task")
    assert drained(stream(), tmp_path).count() == 7
    archive("2024-02.zip", {i: chat(i) for i in range(20, 25)})
    assert sorted(r[0] for r in drained(stream(), tmp_path).collect()) == sorted(f"task {i}" for i in [*range(7), *range(20, 25)])
    assert drained(stream(), tmp_path).count() == 12


# Folds


def events(spark, n=400, seed=2):
    rng = random.Random(seed)
    kinds = [*streams.MOVES, "task_assigned", "task_completed"]
    rows = [(f"t{rng.randrange(25)}", 1_700_000_000 + rng.randrange(200_000) + rng.random(), i, rng.choice(kinds)) for i in range(n)]
    return spark.createDataFrame(rows, "task string, s double, seq long, kind string").select("task", F.timestamp_seconds("s").alias("ts"), "seq", "kind")


@pytest.mark.parametrize("fold", [ordered.LastBefore("kind", "task_assigned", "task_completed"), ordered.Leases("kind", streams.MOVES, 3000)])
def test_the_stream_gives_what_the_batch_gives(live_spark, tmp_path, fold):
    """Over files in random order, through a restart in the middle, up to the watermark."""
    rows = events(live_spark)
    parts = [r for r in rows.randomSplit([1, 1, 1, 1], 5)]
    stream = lambda: ordered.in_order(live_spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "task", "ts", fold, "10 days", "seq")
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 1:
            assert drained(stream(), tmp_path).count() == 0  # all within what may still come late
    drained(stream(), tmp_path)
    live_spark.createDataFrame([("end", 4_000_000_000.0, 0, "none")], "task string, s double, seq long, kind string").select("task", F.timestamp_seconds("s").alias("ts"), "seq", "kind").write.mode("append").parquet(f"{tmp_path}/in")
    got = drained(stream(), tmp_path)
    mark = (4_000_000_000 - 10 * 86400) * 1_000_000
    want = ordered.folded(rows, "task", "ts", fold, "seq", mark)
    assert want.count() > 50 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_leases_by_hand(live_spark):
    rows = [("a", 0, "publish"), ("a", 10, "claim"), ("a", 500, "return"), ("b", 0, "publish"), ("b", 5, "claim"), ("b", 50, "return"), ("b", 60, "archive"), ("c", 3, "claim"), ("d", 0, "publish"), ("d", 1, "claim")]
    df = live_spark.createDataFrame(rows, "task string, s long, kind string").select("task", F.timestamp_seconds("s").alias("ts"), "kind")
    fold = ordered.Leases("kind", streams.MOVES, 100)
    got = sorted((r.task, r.at // 10**6, r.state) for r in ordered.folded(df, "task", "ts", fold, upto=10**9).collect())
    want = [("a", 0, "sent"), ("a", 10, "processing"), ("a", 110, "sent"), ("b", 0, "sent"), ("b", 5, "processing"), ("b", 50, "returned"), ("b", 60, "archived"), ("d", 0, "sent"), ("d", 1, "processing"), ("d", 101, "sent")]
    assert got == want
    early = [(r.task, r.state) for r in ordered.folded(df, "task", "ts", fold, upto=20 * 10**6).collect()]
    assert ("a", "processing") in early and ("d", "processing") in early and early.count(("a", "sent")) == 1


def test_folds_over_odd_rows(live_spark):
    df = live_spark.createDataFrame([(None, 1, "task_assigned"), ("a", None, "task_assigned"), ("a", 5, "task_completed"), ("a", 6, "task_assigned"), ("a", 6, "task_completed"), ("a", 9, None), ("a", 10, "task_completed")], "task string, s long, kind string")
    df = df.select("task", F.timestamp_seconds("s").alias("ts"), "kind", (F.col("kind") != "task_assigned").cast("long").alias("o"))
    fold = ordered.LastBefore("kind", "task_assigned", "task_completed")
    assert sorted(r.seconds for r in ordered.folded(df, "task", "ts", fold, "o").collect()) == [0.0, 4.0]
    assert ordered.folded(df.limit(0), "task", "ts", fold, "o").count() == 0
    words = ordered.WordsMet("text", {"Stop": 2, "end": 1}, any_word=False)
    said = live_spark.createDataFrame([("c", i, t) for i, t in enumerate(["stop", None, "END", "please STOP", "stop end"])], "conv string, s long, text string").select("conv", F.timestamp_seconds("s").alias("ts"), "text")
    assert [(r.at // 10**6, r.reason) for r in ordered.folded(said, "conv", "ts", words).collect()] == [(3, "end, stop")]


def test_words_met_keep_their_state_over_batches(live_spark, tmp_path):
    rows = live_spark.createDataFrame([(f"c{i % 3}", i, "the end" if i % 4 == 0 else None) for i in range(40)], "conv string, s long, text string").select("conv", F.timestamp_seconds("s").alias("ts"), "text")
    fold = ordered.WordsMet("text", {"the": 3})
    for low in (30, 20, 10, 0):  # the latest first
        rows.where((F.col("ts") >= F.timestamp_seconds(F.lit(low))) & (F.col("ts") < F.timestamp_seconds(F.lit(low + 10)))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live_spark.createDataFrame([("end", 10**9, "x")], "conv string, s long, text string").select("conv", F.timestamp_seconds("s").alias("ts"), "text").write.mode("append").parquet(f"{tmp_path}/in")
    stream = live_spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drained(ordered.in_order(stream, "conv", "ts", fold, "1 hour"), tmp_path)
    assert sorted(map(str, got.collect())) == sorted(map(str, ordered.folded(rows, "conv", "ts", fold).collect())) and got.count() == 3


# Table functions


def test_chunks_equal_the_plain_chunkers(live_spark):
    docs = live_spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.createOrReplaceTempView("chunked")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = lambda call: [r for r in live_spark.sql(f"SELECT d.doc_id, c.* FROM chunked d, LATERAL {call} c").collect()]
    by = lambda found: {i: [r.chunk for r in sorted(found, key=lambda r: r.n) if r.doc_id == i] for i in texts}
    chars = rows("chunks(d.text, 'chars', 400)")
    assert by(chars) == {i: parsing.char_chunks(t or "", 400) for i, t in texts.items()}
    assert all((texts[r.doc_id])[r.start : r.start + len(r.chunk)] == r.chunk for r in chars)
    assert by(rows("chunks(d.text, 'tokens', 50)")) == {i: parsing.token_chunks(t or "", 50) for i, t in texts.items()}


def test_columns_depend_on_the_call(live_spark):
    one = lambda call: live_spark.sql(f"SELECT * FROM {call}")
    assert one("chunks('a b c d e', 'windows', 3, 1)").columns == ["n", "first_word", "chunk"]
    assert [tuple(r) for r in one("chunks('a b c d e', 'windows', 3, 1)").collect()] == [(0, 0, "a b c"), (1, 2, "c d e")]
    assert one("chunks('x', 'chars', 3)").columns == ["n", "start", "chunk"] and one("chunks(CAST(NULL AS STRING), 'chars', 3)").count() == 0 and one("chunks('', 'windows', 3)").count() == 0
    assert [tuple(r) for r in one("matches('a=1, b=22', '(?<k>[a-z])=(?<v>[0-9]+)')").collect()] == [(0, 0, "a", "1"), (1, 5, "b", "22")]
    for wrong in ("chunks('x', 'pages', 3)", "chunks('x', 'chars', 0)", "chunks('x', 'chars', 3, 1)", "chunks('x', 'windows', 3, 3)", "matches('x', 'x')", "chunks('x', 'chars', CAST(rand() AS INT))"):
        with pytest.raises(Exception, match="must be|unknown kind|names no group"):
            one(wrong).collect()
