"""WAV files and fingerprints as data sources."""

import random
import wave

import pytest

from cadenza.operators import sound
from cadenza.sources import audio, views


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("music"), random.Random(1)
    (top / "deep").mkdir()
    for name, channels, rate, n in (("a.wav", 1, 8000, 1000), ("deep/b.WAV", 2, 44_100, 777), ("c.wav", 3, 8000, 5), ("empty.wav", 1, 8000, 0)):
        with wave.open(str(top / name), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(rng.randbytes(2 * channels * n))
    whole = (top / "a.wav").read_bytes()
    # A chunk of another kind before the sound, of odd length.
    (top / "extra.wav").write_bytes(b"RIFF" + (len(whole) + 4).to_bytes(4, "little") + whole[8:36] + b"LIST\x03\x00\x00\x00abc\x00" + whole[36:])
    (top / "cut.wav").write_bytes(whole[:501])
    (top / "bad.wav").write_bytes(b"RIFFxxxx")
    (top / "none.wav").write_bytes(b"")
    (top / "notes.txt").write_text("no sound")
    (top / "big.mp3").write_bytes(rng.randbytes(3 * audio.MIB + 5))
    (top / "edge.mp3").write_bytes(rng.randbytes(2 * audio.MIB))
    return top


@pytest.mark.parametrize("size", [64, 1001, 1 << 20])
def test_frames_by_ranges(spark, folder, size):
    audio.register(spark)
    got = spark.read.format("cadenza_wav").option("range", size).load(str(folder))
    rows = sorted(map(tuple, got.collect()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    want = sorted((r["path"].removeprefix("file:"), r["rate"], r["ch"], r["i"], r["v"]) for r in sound.decoded(files.filter("path like '%.wav' or path like '%.WAV'")).collect())
    assert rows == want
    # A file that ends early gives the whole frames that it has.
    assert [r[3] for r in rows if r[0].endswith("cut.wav")] == list(range((501 - 44) // 2))


def test_a_filter_opens_few_files(spark, folder, monkeypatch):
    reader = audio.WavReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("path",), f"{folder}/a.wav"), GreaterThan(("i",), 5), In(("path",), (f"{folder}/a.wav", "x"))]))
    assert rest == [GreaterThan(("i",), 5)] and [p.files[0][0] for p in reader.partitions()] == [f"{folder}/a.wav"]
    audio.register(spark)
    one = spark.read.format("cadenza_wav").load(str(folder)).filter(f"path = '{folder}/c.wav' and i >= 2")
    assert one.count() == 9


def test_fingerprints_are_the_scan_s(spark, folder):
    audio.register(spark)
    got = spark.read.format("cadenza_fingerprint").load(str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, views.scan_audio(spark, str(folder)).collect()))


def test_fingerprints_read_two_mib_at_most(folder, monkeypatch):
    seen = []

    class Counted:
        def __init__(self, source):
            self.source = source

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.source.close()

        def seek(self, at):
            self.source.seek(at)

        def read(self, n):
            seen.append(n)
            return self.source.read(n)

    real, where = audio.opened(str(folder))

    class System:
        get_file_info = staticmethod(real.get_file_info)
        open_input_file = staticmethod(lambda p: Counted(real.open_input_file(p)))

    monkeypatch.setattr(audio, "opened", lambda f: (System, where))
    reader = audio.FingerprintReader({"path": str(folder)})
    for part in reader.partitions():
        for path, size in part.files:
            seen.clear()
            assert len(list(reader.read(audio.Part([(path, size)])))) == 1
            assert sum(seen) <= 2 * audio.MIB


def test_no_folder(spark, tmp_path):
    audio.register(spark)
    for name in ("cadenza_wav", "cadenza_fingerprint"):
        assert spark.read.format(name).load(str(tmp_path / "none")).collect() == []
