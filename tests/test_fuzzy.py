"""Fuzzy resolution against loops over all pairs."""

import random
import time

import numpy as np
import pytest

from cadenza.operators import fuzzy

WORDS = ["beyoncé", "beyonce", "halo", "noa", "kirel", "unicorn", "sia", "u2", "one", "the", "kids", "דנה", "חי", "wonderwall", "aaaaaaa", "x" * 70]
TRACKS = "track_id long, title string, artist string"


def library(songs):
    """Keys as one program would hold them: by first place; the last file of a key; folded keys to the later key."""
    keys = {}
    for i, t, a in sorted(songs):
        keys[f"{a} {t}".strip()] = i
    order = {k: n for n, k in enumerate(keys)}
    bare = {}
    for k in keys:
        bare[fuzzy.folded(k)] = k
    return keys, order, bare


def plain(key, lib, threshold):
    keys, _, bare = lib
    for asked, choices in ((key, {k: i for k, i in keys.items()}), (fuzzy.folded(key), {f: keys[k] for f, k in bare.items()})):
        best = None
        for k, i in choices.items():
            s = fuzzy.token_set_ratio(asked.split(), k.split())
            if best is None or s > best[0]:
                best = (s, i)
        if best and best[0] >= threshold:
            return best
    return None


def songs_and_asked(rng, n):
    songs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 4))), rng.choice(WORDS)) for i in range(n)]
    songs += [(n, "café", "zed"), (n + 1, "cafè", "zed"), (n + 2, "cafe", "zed"), (n + 3, "café", "zed")]
    asked = ["beyonce", "halo beyoncé", "unicorm noa kirel", "xyz qqq", "siá", "the one", "haalo", "דנה חי", "zed cafê", "zed cafe", "zed", "x" * 66, "x" * 70 + "y halo", "aaaaaaab", "q"]
    asked += ["".join(c for c in f"{a} {t}" if rng.random() > 0.12).strip() for _, t, a in songs[:60]]
    asked += [" ".join(rng.sample(f"{a} {t} {rng.choice(WORDS)}".split(), 2)) for _, t, a in songs[:40]]
    return songs, [" ".join(k.split()) for k in asked if k]


@pytest.mark.parametrize("small", [False, True])
def test_nothing_is_lost(spark, small, monkeypatch):
    if small:
        for name, value in (("LANE", 16), ("BLOCK", 8), ("FIRST", 1)):
            monkeypatch.setattr(fuzzy, name, value)
    songs, asked = songs_and_asked(random.Random(3), 120)
    tracks = spark.createDataFrame(songs, TRACKS).repartition(4)
    lost = spark.createDataFrame([(k,) for k in asked], "key string").repartition(3)
    lib = library(songs)
    got = {r["key"]: (r["match_score"], r["track_id"]) for r in fuzzy.resolve_fuzzy(lost, tracks).collect()}
    assert got == {k: hit for k in asked if (hit := plain(k, lib, 82))}
    near = {r["key"]: (r["match_score"], r["track_id"]) for r in fuzzy.near_misses(lost, tracks).collect()}
    assert near == {k: plain(k, lib, 40) or (0.0, None) for k in asked if k not in got}


def test_equal_without_marks_is_the_later_file(spark):
    tracks = spark.createDataFrame([(1, "café", "zed"), (2, "cafè", "zed"), (3, "halo", "zed")], TRACKS)
    asked = spark.createDataFrame([("zed cafê",)], "key string")
    assert [tuple(r) for r in fuzzy.resolve_fuzzy(asked, tracks, 99.0).collect()] == [("zed cafê", 2, 100.0)]
    # As written, the two tie, and the first is meant.
    assert fuzzy.resolve_fuzzy(asked, tracks).first()["track_id"] == 1


def test_odd_songs_and_libraries(spark):
    none = spark.createDataFrame([], TRACKS)
    asked = spark.createDataFrame([("halo",), ("",), (None,), ("halo",)], "key string")
    assert fuzzy.resolve_fuzzy(asked, none).collect() == []
    assert {(r["key"], r["match_score"]) for r in fuzzy.near_misses(asked, none).collect()} == {("halo", 0.0), ("", 0.0), (None, 0.0)}
    some = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "halo", None)], TRACKS)
    assert [tuple(r) for r in fuzzy.resolve_fuzzy(asked, some).collect()] == [("halo", 3, 100.0)]


def test_bounds_hold_and_scores_agree():
    rng = random.Random(5)
    letters = "abcdefgh é"
    forms = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 30))).split()) or "a" for _ in range(400)]
    lane = fuzzy.Lane(forms)
    everywhere = (np.arange(len(forms)),)
    for _ in range(60):
        key = " ".join("".join(rng.choices(letters, k=rng.randint(1, 80))).split()) or "b"
        scores = [fuzzy.token_set_ratio(key.split(), f.split()) for f in forms]
        tokens = sorted({*key.split()})
        outer = lane.common(tokens)
        bound = lane.bound(" ".join(tokens))
        for i, s in enumerate(scores):
            assert s <= bound[i] or outer[i] > 0
        for least in (0.0, 40.0, 82.0):
            want = (max(scores), scores.index(max(scores))) if max(scores) >= least else (-1.0, -1)
            assert lane.best(key, everywhere, least) == [want]


def test_few_forms_are_scored(monkeypatch):
    """Of a large library a song is compared with the few that the bounds leave."""
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(3000)]
    forms = sorted({" ".join(rng.sample(names, 3)) for _ in range(fuzzy.LANE)})
    lane, order = fuzzy.Lane(forms), (np.arange(len(forms)),)
    scored, real = [0], lane.subsequences
    monkeypatch.setattr(lane, "subsequences", lambda p, at: scored.__setitem__(0, scored[0] + len(at)) or real(p, at))
    began = time.time()
    for f in forms[:200]:
        lane.best("".join(c for c in f if rng.random() > 0.1), order, 82.0)
    assert scored[0] / 200 < 0.01 * len(forms) and time.time() - began < 20
