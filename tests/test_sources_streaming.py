from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators.enrich import BATCH, cached, run_stage, two_stage, word_ends
from lectern.operators.frequency import latest_by
from lectern.operators.ordinal import occurrence, running_offset
from lectern.operators.repair import absorb_wordless, sections, shift_openers
from lectern.sources.books import DictdSource, append_cache, base64_number, export_json, plain_entry, read_cache, read_index, read_manifest, read_map, read_text, sense_entry, write_atomically, write_map, write_review
from lectern.streaming.build import incremental, sessions
from lectern.streaming.speech import endpoints_stream


def test_texts_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Tür\n".encode("latin-1"))
    row = read_text(spark, str(tmp_path / "a.txt"), "ISO-8859-1").first()
    assert row.text == "Tür\n" and row.source_hash.startswith("sha256:") and len(row.source_hash) == 19


def test_manifest(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[b]\nlang="de"\nsource="b.txt"\n[a]\nlang="en"\nskip_until="^X"\n')
    assert [r.book_id for r in read_manifest(spark, str(tmp_path / "m.toml")).orderBy("ord").collect()] == ["b", "a"]
    assert read_manifest(spark, str(tmp_path / "m.toml"), ["a"]).first().skip_until == "^X"
    with pytest.raises(ValueError):
        read_manifest(spark, str(tmp_path / "m.toml"), ["z"])


def test_index_cache_and_maps(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"schema": 3, "books": [{"id": "x", "lang": "de", "stats": {"words": 3}}]}, indent=1))
    assert read_index(spark, str(tmp_path / "i.json")).first().stats.words == 3
    cache = str(tmp_path / "cache")
    for v in ("old", "new"):
        append_cache(spark.createDataFrame([("p|x", v)], "k string, v string").coalesce(1), cache)
    assert read_cache(spark, cache).first().v in ("old", "new")
    path = str(tmp_path / "map.json")
    assert write_map(spark.createDataFrame([("b", "2"), ("a", "1"), ("_x", "0")], "k string, v string"), "k", "v", path, "test") == 2
    assert list(read_map(path)) == ["a", "b"] and list(json.loads((tmp_path / "map.json").read_text()))[0] == "_meta"
    export_json(spark.createDataFrame([(1, "ä")], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":"ä"}'


def test_atomic_write_leaves_no_half_file(tmp_path):
    target = tmp_path / "x"
    target.write_text("old")

    def broken(path):
        raise OSError

    with pytest.raises(OSError):
        write_atomically(str(target), broken)
    assert target.read_text() == "old"


def b64(n):
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = ""
    while True:
        out, n = alphabet[n % 64] + out, n // 64
        if not n:
            return out


def test_dictionary_source(spark, tmp_path):
    entries = {"Leben": "Leben /x/ <neut, n, sg>\n1. life, living, being, existence; more", "leben": "leben <v>\nto live [note]", "öd": "öd\nNote: x\n{old} barren"}
    data, lines = b"", []
    for head, text in entries.items():
        raw = text.encode()
        lines.append(f"{head}\t{b64(len(data))}\t{b64(len(raw))}\n")
        data += raw
    (tmp_path / "d.index").write_text("".join(lines) + "broken line\n", encoding="utf-8")
    with gzip.open(tmp_path / "d.dict.dz", "wb") as f:
        f.write(data)
    spark.dataSource.register(DictdSource)
    got = spark.read.format("dictd").options(index=str(tmp_path / "d.index"), dict=str(tmp_path / "d.dict.dz"), lang="de", partitions=2).load()
    assert {(r.key, r.gloss, tuple(r.tags)) for r in got.collect()} == {("leben", "life, living, being", ("n",)), ("leben", "to live", ("v",)), ("öd", "barren", ())}
    assert base64_number("BA") == 64


def test_entries():
    raw = 'peep\n  n 1: the short cry of a bird [syn: {cheep}]\n    2: a secret look\n  v 1: look furtively; "he peeped"\n  s 1: small'
    assert sense_entry(raw, "v") == ("peep", "look furtively") and sense_entry(raw, "adj")[1] == "small" and sense_entry(raw)[1] == "the short cry of a bird" and sense_entry("x\nnothing") == ("x", "")
    assert plain_entry("x\n\n") == ("x", "", [])


def test_review_page(spark, tmp_path):
    s = spark.createDataFrame([("k1", 0, 1, "ab", "Two words"), ("k0", 0, 0, "aa", "One")], "sent_key string, sec_idx int, sent_idx int, id string, text string")
    p = spark.createDataFrame([("k0", "starter", 0, "One"), ("k1", "starter", 1, "words"), ("k1", "starter", 0, "Two")], "sent_key string, level string, ci int, t string")
    write_review(s, p, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "\n**1. One**  `aa`\n\n- starter: One\n\n**2. Two words**  `ab`\n\n- starter: Two | words\n"


def test_stage_asks_in_batches_and_keeps_the_cache(spark):
    cache = spark.createDataFrame([("p|a", "1", 1), ("p|a", "2", 2), ("q|b", "9", 3), ("p|a|b", "3", 4)], "k string, v string, seq long")
    assert {(r.item, r.v) for r in cached(cache, "p").collect()} == {("a", "2"), ("a|b", "3")}
    items = spark.createDataFrame([(f"x{i}",) for i in range(BATCH + 5)] + [("a",), ("a",), (None,)], "item string")

    def client(prompt, keys):
        assert len(keys) <= BATCH
        return {k: f"{prompt}/{len(keys)}" for k in keys if k != "x0"} | {"unasked": "!"}

    got = {r.item: (r.v, r.source) for r in run_stage(items, "p", cached(cache, "p"), client).collect()}
    assert len(got) == BATCH + 6 and got["a"] == ("2", "cache") and got["x0"] == (None, "asked") and "unasked" not in got
    graded = two_stage(spark.createDataFrame([("a", True, True), ("b", True, None), ("c", None, True)], "i string, s boolean, g boolean"), F.col("s"), F.col("g"))
    assert {r.i: r.verdict for r in graded.collect()} == {"a": "kept", "b": "rejected", "c": "insane"}


def test_phoneme_stream(spark):
    rows = [("s", 0, 0, "^", 10), ("s", 0, 1, "a", 100), ("s", 0, 2, "b", 100), ("s", 0, 3, " ", 50), ("s", 0, 4, "c", 100), ("s", 1, 0, "d", 100), ("s", 1, 1, "$", 10)]
    df = spark.createDataFrame(rows, "k string, chunk_no int, ord int, phoneme string, num_samples int")
    assert sorted((r.word, r.phonemes, r.end) for r in word_ends(df, ["k"], 100).collect()) == [(0, "ab", 2.1), (1, "c", 3.6), (2, "d", 4.6)]


def test_ordinals_equal_one_window(spark):
    df = spark.createDataFrame([("b", s, i, i % 3) for s in (2, 0, 1) for i in range(7)] + [(None, 0, 0, 5)], "b string, s int, i int, w int")
    got = {(r.b, r.s, r.i): r.o for r in running_offset(df, ["b"], "s", ["i"], F.col("w"), "o").collect()}
    total = 0
    for s in (0, 1, 2):
        for i in range(7):
            assert got["b", s, i] == total
            total += i % 3
    assert got[None, 0, 0] == 0 and sorted(r.occ for r in occurrence(df, ["b"], "s", ["i"]).collect()) == sorted([*range(21), 0])


def test_repairs(spark):
    paras = spark.createDataFrame([(1, i, p) for i, p in enumerate(["intro text.", "Chapter One", "Chapter Two", "it was.", "it is.", "III.", "end."])], "d int, i int, p string")
    assert [(r.sec_idx, r.title, r.p) for r in sections(paras, ["d"], "i", "p").orderBy("i").collect()] == [(0, "", "intro text."), (1, "Chapter Two", "it was."), (1, "Chapter Two", "it is."), (2, "III.", "end.")]
    units = spark.createDataFrame([("a", i, t) for i, t in enumerate(["„", "Ja", "“", "…", "nein"])] + [("b", 0, "—")], "k string, i int, t string")
    assert [(r.i, r.parts, r.shift) for r in absorb_wordless(units, ["k"], "i", "t").orderBy("i").collect()] == [(1, ["„", "Ja", "“", "…"], 1), (4, ["nein"], 0)]
    pieces = spark.createDataFrame([("a", 0, "er rief: „"), ("a", 1, "Komm“"), ("a", 2, "„"), ("a", 3, "x („")], "k string, i int, t string").withColumn("lang", F.lit("de"))
    assert [r.t for r in shift_openers(pieces, ["k"], "i", "t", "lang").orderBy("i").collect()] == ["er rief:", "„Komm“", "„", "x („"]


def test_incremental_build_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[("a", 1), ("b", 1), ("b", 1)], [("b", 2), ("c", 2)]]):
        spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, v int").option("maxFilesPerTrigger", 1).parquet(source)
        incremental(stream, out, ["id"], str(tmp_path / f"cp{k}")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 1), ("c", 2)]


def test_sessions_stream_equals_table(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 02:00:00", 4.0), (2, "2024-01-01 00:00:00", 8.0), (3, "2024-01-09 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    query = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = {(r.user_id, r.n, r.total) for r in spark.table("sess").collect()}
    assert closed == {(r.user_id, r.n, r.total) for r in sessions(df).collect() if r.user_id != 3}


def test_take_state_survives_batches(spark, tmp_path):
    frames = [("a", 20.0 * i, 0.5 if i < 30 else 0.0) for i in range(100)]
    for part in (frames[:20], frames[20:]):
        spark.createDataFrame(part, "take string, t double, peak double").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("take string, t double, peak double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    query = endpoints_stream(stream).writeStream.format("memory").queryName("takes").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(r.event for r in spark.table("takes").collect()) in (["speech", "stop"], ["speech"])


def test_latest_by_of_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x"}), (1, 1, {"a": "y"}), (1, 0, {"a": "z"})], "k int, v int, m map<string,string>")
    assert len(latest_by(df, "k", "v").collect()) == 1
