"""Set building, resolution, payloads, options and job streams against literal values and plain loops."""

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza import config
from cadenza.functions import music, text
from cadenza.operators import charts, library, matching, sets, sound
from cadenza.sources import views
from cadenza.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_set_tempo_counts_like_a_loop(spark):
    rng = random.Random(8)
    bpms = [round(rng.uniform(60, 200), 3) for _ in range(300)] + [100.0, 108.0, 92.0, 3.0, 5000.0, 0.0]
    tracks = spark.createDataFrame(list(enumerate(bpms)), "track_id long, bpm double")

    def fold(b):
        for _ in range(4):
            b = b * 2 if b < 82 else b / 2 if b > 164 else b
        return b

    folded = [fold(b) for b in bpms if b > 0]
    sizes = [sum(abs(f - c) / c <= 0.08 for f in folded) for c in folded]
    best = folded[sizes.index(max(sizes))]
    cluster = [f for f in folded if abs(f - best) / best <= 0.08]
    got = matching.set_tempo(tracks).first()
    assert got["n"] == len(cluster) == max(sizes) and got["tempo"] == pytest.approx(statistics.median(cluster), abs=1e-6)
    f = tracks.filter("bpm > 0").select("track_id", music.fold_tempo(F.col("bpm"))["bpm"].alias("f"))
    counted = {round(r["f"], 9): r["size"] for r in matching.cluster_sizes(f, 0.08).collect()}
    assert counted == {round(c, 9): n for c, n in zip(folded, sizes, strict=True)}
    assert matching.set_tempo(tracks.limit(0)).first()["tempo"] == 0.0


def test_bars(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    none = arr()
    grid = lambda down, beats, bpm, dur: one(spark, sets.bar_grid(down, beats, F.lit(bpm), F.lit(dur)))
    assert grid(arr(1.0, 3.0), none, 120.0, 9.0) == [1.0, 3.0] and grid(none, arr(*range(9)), 120.0, 9.0) == [0.0, 4.0, 8.0]
    assert grid(none, none, 120.0, 5.0) == [0.0, 2.0, 4.0] and grid(none, none, 0.0, 1.0) == [0.0]
    g = arr(0.0, 2.0, 4.0, 6.0, 8.0)
    snap = lambda t, prefer: one(spark, sets.snapped(g, F.lit(t), prefer))
    assert [snap(3.0, "nearest"), snap(2.0, "next"), snap(2.1, "next"), snap(99.0, "next"), snap(3.9, "prev"), snap(-1.0, "prev")] == [2.0, 2.0, 4.0, 8.0, 2.0, 0.0]
    assert one(spark, sets.snapped(none, F.lit(3.5), "next")) == 3.5
    cut = lambda start, bars: tuple(one(spark, sets.slice_bars(g, F.lit(start), F.lit(bars), F.lit(120.0), F.lit(9.0))))
    assert cut(1.0, 2) == (2.0, 6.0, 2) and cut(4.0, 8) == (4.0, 8.0, 2) and cut(8.0, 3) == (8.0, 9.0, 3)
    assert one(spark, sets.latest_start(g, F.lit(2))) == 4.0 and one(spark, sets.latest_start(arr(3.0), F.lit(2))) == 0.0
    assert one(spark, sets.segment_bars(30.0, F.lit(8), F.lit(120.0), 8)) == 116 and one(spark, sets.segment_bars(1.0, F.lit(40), F.lit(120.0), 8)) == 8


def test_hype_off_and_gaps(spark):
    cues = spark.createDataFrame([(1, 0.5, 1, "cue", "drop"), (1, 50.0, 2, "cue", "drop"), (1, 55.0, 3, "cue", "drop"), (1, 90.0, 4, "track_in", "x")], "set_id int, time double, ordinal int, kind string, label string")
    tempi = spark.createDataFrame([(1, 120.0)], "set_id int, tempo double")
    assert sets.hype(cues, tempi, "off", 1).count() == 0
    got = [(r["element"], r["start"], r["gain_db"]) for r in sets.hype(cues, tempi, "heavy", 1).orderBy("start").collect()]
    # Nothing in the first bar, nothing too near, a riser that ends on its cue.
    assert got == [("riser", 48.0, -6.0), ("impact", 50.0, -7.0), ("airhorn", 51.0, -8.0)]


def test_texts(spark):
    assert one(spark, text.normalize(F.lit("Ｆｕｌｌ ﬁre (Live)"))) == "fire"
    assert one(spark, text.strip_diacritics(F.lit("Beyoncé שָׁלוֹם"))) == "Beyonce שלום" and one(spark, text.strip_diacritics(F.lit(None).cast("string"))) is None
    assert one(spark, text.clean_title(F.lit("2001-05 03 - Sia - Chandelier"), F.lit("sia"))) == "Chandelier"
    assert one(spark, text.clean_title(F.lit("07"), F.lit("x"))) == "07"
    assert [one(spark, text.seconds(F.lit(x))) for x in ("1:02:03", "2:30", "41.5", "junk", "")] == [3723.0, 150.0, 41.5, 0.0, 0.0]
    with pytest.raises(Exception, match="not a duration"):
        one(spark, text.seconds(F.lit("1:xx")))
    tag = lambda stem: tuple(one(spark, library.named_by_file(F.lit(stem), F.lit(""), F.lit(None).cast("string"))))
    assert tag("A - B - C") == ("B - C", "A") and tag("A | B – C") == ("C", "A | B") and tag("alone") == ("alone", "")


def test_chart_payloads(spark):
    rows = lambda p, payload, **k: [(r["title"], r["artist"], r["rank"]) for r in views.chart_rows(spark.createDataFrame([("IL", json.dumps(payload))], "region string, payload string"), p, **k).collect()]
    track = lambda n, a: {"name": n, "artist": {"name": a}, "url": "u"}
    assert rows("a", {"tracks": {"track": track("x", "y")}}) == [("x", "y", 1)]
    assert rows("a", {"tracks": {"track": [track("", "y"), track("x", "y")]}}) == [("x", "y", 2)]
    with pytest.raises(Exception, match="Invalid API key"):
        rows("a", {"error": 10, "message": "Invalid API key"})
    results = [{"name": f"n{i}", "artistName": "a"} for i in range(120)]
    assert len(rows("b", {"feed": {"results": results}})) == 50 and len(rows("b", {"feed": {"results": results}}, limit=3)) == 10 and len(rows("b", {"feed": {"results": results}}, limit=500)) == 100
    item = lambda t, c: {"snippet": {"title": t, "channelTitle": c}}
    assert rows("c", {"items": [item("", "q"), item("A - B (Official Video)", "q"), item("Solo", "Band - Topic")]}) == [("B", "A", 2), ("Solo", "Band", 3)]


def test_merge_of_other_regions(spark):
    rows = [("p", "XX", 1, 1, "s", "t"), ("q", "global", 2, 4, "u", "v"), ("p", "XX", 2, 2, "u", "v")]
    got = {r["title"]: r for r in charts.merge_trends(spark.createDataFrame(rows, "provider string, region string, song int, rank int, title string, artist string").withColumn("url", F.lit("l"))).collect()}
    assert got["s"]["score"] == 0.5 and got["s"]["region"] == "global" and got["s"]["url"] == "l"
    assert got["u"]["best_rank"] == 4 and got["u"]["providers"] == "p,q"


def test_options_and_tuning(tmp_path, monkeypatch):
    assert library.check_options(length_minutes=30, track_count=None, source="trends") == {"length_minutes": 30, "source": "trends"}
    for bad in ({"length_minutes": 0}, {"israel_ratio": 1.1}, {"track_count": 41}, {"hype": "loud"}):
        with pytest.raises(ValueError):
            library.check_options(**bad)
    w = config.Weights(1, 1, 1, 1).normalized()
    assert (w.tempo, w.key, w.chroma, w.energy) == (0.25,) * 4
    with pytest.raises(ValueError):
        config.Weights(0, 0, 0, 0).normalized()
    assert config.tuned({"min_score": 0.5, "weights": {"tempo": 1.0}}).weights.tempo == 1.0
    with pytest.raises(ValueError, match="unknown"):
        config.tuned({"nope": 1})
    assert library.load_tuning(str(tmp_path / "none.yaml")) == config.DEFAULT
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"top_n": 3}), encoding="utf-8")
    monkeypatch.setenv("CADENZA_CONFIG", str(tmp_path / "c.yaml"))
    assert library.load_tuning().top_n == 3
    assert library.fx_settings(None, "club", {"wash": 0.5, "sidechain": None})["wash"] == 0.5 and library.fx_settings(None, "odd")["sidechain"] == 0.0
    assert library.known_providers(["b", "x", "a"], {"a": 1, "b": 2}) == [2, 1]


def test_stems_and_rows(spark):
    stems = spark.createDataFrame([("h", "a", "b", "c", "d"), ("k", "a", "b", "c", "gone")], "file_hash string, vocals string, drums string, bass string, other string")
    files = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    assert [r["file_hash"] for r in library.stems_ready(stems, files).collect()] == ["h"]
    assert library.one_row(files.filter("path = 'a'"), "track").count() == 1
    with pytest.raises(LookupError, match="track: not found"):
        library.one_row(files.filter("path = 'z'"), "track")


def test_places_without_one_task(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["ab", "abc", "b", "", "aa", "z", None]), rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, x int").repartition(6)
    got = {r["id"]: r["place"] for r in library.placed(df, [F.col("g"), F.desc("x"), F.col("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[2], r[0]))]
    assert sorted(got.values()) == list(range(1, 201)) and library.placed(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("keys", ["prefix", "one"])
def test_places_of_hot_keys_are_spread(spark, keys, monkeypatch):
    from cadenza.operators import store

    n, written = 40_000, []
    monkeypatch.setattr(library, "kept", lambda df: written.append(store.kept(df)) or written[-1])
    g = F.concat(F.lit("Brand"), F.col("id") % 977) if keys == "prefix" else F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = library.placed(spark.range(n).select("id", g.alias("g")), [F.col("g"), F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    assert df.select(F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b")).first()[:] == (n, 1, n)


def test_routes(spark):
    from cadenza import api

    d = "/root/testdata/sf0.001"
    t, s, c, b = views.tracks(spark, d), views.sections(spark, d), views.chroma(spark, d), views.beats(spark, d)
    r = api.analysis(t, s, b, 3).first()
    assert r["downbeat_count"] == -(-r["beats"] // 4) and len(r["downbeats"]) <= 64 and r["sections"][0]["idx"] == 0 and r["bpm"] == 81.1
    pairs = api.match(t, s, c, 1, 2, top=5).collect()
    assert [p["place"] for p in pairs] == list(range(1, len(pairs) + 1)) and [p["total"] for p in pairs] == sorted((p["total"] for p in pairs), reverse=True)
    with pytest.raises(LookupError):
        api.track(t, -1)
    keys = api.set_key(spark.createDataFrame([(1, 0, False), (2, 3, True)], "track_id long, pitch_class int, minor boolean"), 2, 7, "major")
    assert sorted(map(tuple, keys.collect())) == [(1, 0, False), (2, 7, False)] and api.reset_key(keys, 1).count() == 1
    with pytest.raises(ValueError):
        api.set_key(keys, 2, 12, "major")
    merged = charts.merge_trends(views.charts(spark, d))
    assert api.trends(merged).count() == 100 and api.missing(merged, t.limit(0)).count() == 50
    history = spark.createDataFrame([(1, 5.0), (2, 9.0)], "mix_id int, created_at double")
    assert [r["mix_id"] for r in api.mixes(history).collect()] == [2, 1] and api.mix(history, 1).count() == 1 and api.jobs(history).first()["mix_id"] == 2


def test_master(spark):
    import math

    from cadenza.operators import levels

    rate, loud = 1600, [(0, i, 0.05 * math.sin(i / 3)) for i in range(4 * 1600)]
    silent = [(1, i, 0.0) for i in range(800)]
    done, report = levels.mastered(spark.createDataFrame(loud + silent, "clip_id int, i long, v double"), rate, -14.0, -1.0)
    r = {x["clip_id"]: x for x in report.collect()}
    assert done.agg(F.max(F.abs("v"))).first()[0] <= 10 ** (-1 / 20) + 1e-9 and abs(r[0]["output_lufs"] + 14) < 2 and r[0]["peak_db"] <= -1.0
    assert r[1]["input_lufs"] is None and r[1]["gain_db"] == 0.0 and r[1]["peak_db"] is None


def test_channels_add_up(spark):
    from cadenza.operators import analysis

    one_ch = spark.createDataFrame([(0, i, 0.1) for i in range(32)], "clip_id int, i int, v double")
    two = one_ch.withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1))))
    a, b = (analysis.gated_loudness(x).first()["lufs"] for x in (one_ch, two))
    assert b - a == pytest.approx(10 * __import__("math").log10(2), abs=1e-5)


def test_files_of_clips(spark, tmp_path):
    import wave

    from cadenza.sources import wav

    samples = spark.createDataFrame([(c, i, (i % 50) / 100) for c in (3, 4) for i in range(70_000)], "clip_id long, i long, v double")
    got = wav.write_files(wav.wav_parts(samples, 8000), str(tmp_path / "w")).collect()
    assert {r["clip_id"]: r["bytes"] for r in got} == {3: 140_044, 4: 140_044}
    with wave.open(str(tmp_path / "w" / "3.wav")) as f:
        assert (f.getnframes(), f.getframerate()) == (70_000, 8000)
    told = spark.createDataFrame([(1, 1, 0.0, "00:00.00", "track_in", "נועה", 5), (1, 2, 3.5, "00:03.50", "cue", "drop", 5)], "set_id int, place int, time double, timecode string, kind string, label string, track_id int")
    text_ = wav.sidecars(told).first()["value"]
    assert "נועה" in text_ and [e["kind"] for e in json.loads(text_)] == ["track_in", "cue"]


def test_scan_of_a_folder(spark, tmp_path):
    import hashlib
    import time

    from cadenza.operators import store

    (tmp_path / "sub").mkdir()
    big = bytes(range(256)) * 4096 * 3  # beyond two megabytes: only both ends count
    for name, data in {"b.MP3": b"x" * 10, "sub/a - שיר.wav": big, "sub/c.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = views.scan_audio(spark, str(tmp_path)).collect()
    assert [r["path"] for r in got] == sorted(str(tmp_path / n) for n in ("b.MP3", "sub/a - שיר.wav"))
    for r in got:
        data = open(r["path"], "rb").read()
        ends = data[: 1 << 20] + (data[-(1 << 20) :] if len(data) > 2 << 20 else b"")
        assert r["id"] == hashlib.sha256(r["path"].encode()).hexdigest()[:16]
        assert r["file_hash"] == hashlib.sha256(str(len(data)).encode() + ends).hexdigest()[:32]
    assert views.scan_audio(spark, str(tmp_path / "none")).count() == 0
    assert abs(one(spark, store.now()) - time.time()) < 60


def test_bad_wav_gives_no_rows(spark):
    assert sound.decoded(spark.createDataFrame([("x", b"not a wav"), ("y", b"")], "path string, content binary")).count() == 0


def test_job_machine_forgets_and_cancels(spark, tmp_path):
    hour = 3600
    ts = lambda s: f"2024-01-01 {s // hour:02d}:{s % hour // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, 0, 7, "start", 50.0), (2, 10, 7, "purchase", 500.0), (3, 20, 7, "late", 1.0), (4, 5, 8, "cancel", 100.0), (5, 6, 8, "start", 200.0)],
        # The watermark passes an hour after the end of job 7, which is then forgotten.
        [(6, 2 * hour, 9, "start", 250.0)],
        [(7, 3 * hour, 7, "again", 100.0), (1, 0, 7, "start", 50.0)],
    ]
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(e, ts(s), u, k, v) for e, s, u, k, v in rows], "event_id long, ts string, user_id long, event_type string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    schema = spark.read.parquet(str(src / "b0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    got = {r["job_id"]: (r["stage"], r["status"], r["n"]) for r in jobs.stream_machine(stream).collect()}
    assert got[8] == ("cancel", "cancelled", 1) and got[9] == ("start", "running", 1)
    # Events after the end are refused; a run after retention starts at one again.
    assert got[7] == ("again", "running", 1)


def test_tracks_are_segmented_as_rows_of_a_batch(spark):
    """No call of Python for each track, and the beats' order does not matter."""
    from cadenza.operators import segments

    rows = [(t, i, float(i), [float(i >= 5 + t), 0.0], 2) for t in (1, 2) for i in reversed(range(10))]
    found = segments.boundaries(spark.createDataFrame(rows, "track_id long, i long, t double, features array<double>, k int").repartition(3))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(1, 6.0), (2, 7.0)}


def test_a_sets_clips_are_made_once(spark):
    from cadenza.plans import catalogue

    plan = catalogue.QUERIES["tracklist"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Sections are read for the cues alone: the clips, which three kinds of events need, are stored.
    assert len(re.findall(r"Scan parquet \[[^\]]*l_partkey", plan)) == 1
    told = spark.createDataFrame([(1, 0, 0.0, 9.0, "verse"), (1, 1, 9.0, 20.0, "drop"), (1, 2, 20.0, 31.0, "chorus"), (2, 0, 0.0, 7.0, "intro")], "track_id int, idx int, start double, end double, label string")
    assert sorted(map(tuple, sets.starts_and_ends(told).collect())) == [(1, 20.0, 31.0), (2, 0.0, 7.0)]
