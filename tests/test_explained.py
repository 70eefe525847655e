"""Why a pair scored what it did, sentence by sentence, and why others are refused."""

import pytest

from cadenza.operators import matching

TRACKS = "track_id long, bpm double, pitch_class int, minor boolean, confidence double"
PAIRS = "a_track_id long, b_track_id long, a_label string, b_label string, a_energy double, b_energy double, tempo double, ratio double, stretch double, key double, shift int, distance int, chroma double, energy_match double, energy_build double, match double, build double"


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([(1, 128.0, 0, False, 0.2), (2, 62.0, 9, True, 0.2), (3, 100.0, 2, False, 0.01), (4, 0.0, 2, False, 0.2)], TRACKS)


def test_sentences(spark, tracks):
    rows = [
        (1, 2, "verse", "drop", 0.5, 0.75, 0.5366, 2.0, 128 / 124, 0.81, -1, 1, 0.934, 0.0, 1.0, 0.643, 0.793),
        (3, 3, "intro", "intro", 0.4, 0.4, 1.0, 1.0, 1.0, 0.5, 0, 0, 0.05, 1.0, 0.0, 0.44, 0.29),
        (1, 3, "a", "b", 0.4, 0.4, 1.0, 1.0, 1.0, 0.5, 2, 4, 0.05, 1.0, 0.0, 0.45, 0.29),
    ]
    told = {(r["a_track_id"], r["b_track_id"]): r for r in matching.explained(spark.createDataFrame(rows, PAIRS), tracks).collect()}
    assert told[1, 2]["reasons"] == [
        "verse -> drop",
        "tempo: double-time, stretch +3.2% to 128.0 BPM (score 0.54, contributes 0.161)",
        "key: 8B vs 8A -> 1A, harmonically compatible, shift -1 semitone (score 0.81, contributes 0.203)",
        "chroma similarity 0.93 at -1 semitones (contributes 0.280)",
        "energy match +0.25 (score 0.00, contributes 0.000)",
    ]
    assert told[1, 2]["share_tempo"] == pytest.approx(0.161) and told[1, 2]["rejected"] is None
    assert told[3, 3]["rejected"] == "score 0.440 below minimum 0.45" and told[3, 3]["reasons"][-1] == "REJECTED: score 0.440 below minimum 0.45"
    assert "same key (low key confidence, de-weighted) (score" in told[3, 3]["reasons"][2]
    # The least score itself passes.
    assert told[1, 3]["rejected"] is None and "4 steps apart on the wheel, shift +2 semitones (low" in told[1, 3]["reasons"][2]
    build = {r["a_track_id"]: r for r in matching.explained(spark.createDataFrame(rows[:1], PAIRS), tracks, "build").collect()}
    assert build[1]["reasons"][4] == "energy build +0.25 (score 1.00, contributes 0.150)"


def test_refusals(spark, tracks):
    flat = [1.0 / 12] * 12
    sections = spark.createDataFrame([(1, 0, 0.0, 20.0, 0.1, 1), (2, 0, 0.0, 20.0, 0.1, 1), (3, 0, 0.0, 20.0, 0.9, 1), (4, 0, 0.0, 20.0, 0.9, 1)], "track_id long, idx int, start double, end double, energy double, vec_id long")
    chroma = spark.createDataFrame([(1, flat)], "vec_id long, chroma array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (4, 1), (3, 5)], "a_track_id long, b_track_id long")
    got = {(r["a_track_id"], r["b_track_id"]): r["rejected"] for r in matching.refusals(pairs, tracks, sections, chroma).collect()}
    assert got == {(1, 3): "tempo incompatible: 128.0 vs 100.0 BPM exceeds +/-8% at every metrical level tried", (4, 1): "tempo incompatible: 0.0 vs 128.0 BPM exceeds +/-8% at every metrical level tried"}
    # Too short sections leave nothing to score.
    short = sections.withColumn("end", sections["start"] + 1)
    assert {r["rejected"] for r in matching.refusals(pairs.filter("b_track_id = 2"), tracks, short, chroma).collect()} == {None}
