"""Each query of the catalogue against its oracle on the smallest tables, and literal vectors."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cadenza.functions import music, text
from cadenza.operators import fuzzy, store
from cadenza.plans import catalogue

DIR = "/root/testdata/sf0.001"


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "part orders supplier customer lineitem events documents embeddings pages".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name in catalogue.ORACLES:
        assert canon(got) == canon(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_music_vectors(spark):
    tempo = lambda a, b, **k: one(spark, music.tempo(F.lit(float(a)), F.lit(float(b)), **k))
    assert tempo(128, 124)["stretch"] == pytest.approx(128 / 124)
    assert tempo(87.5, 175)["ratio"] == 0.5 and tempo(87.5, 175)["stretch"] == 1.0
    assert tempo(120, 80)["score"] == 0 and tempo(120, 80, three_two=True)["score"] > 0
    assert tempo(0, 120)["score"] == 0 and tempo(120, -5)["score"] == 0
    fold = lambda b: one(spark, music.fold_tempo(F.lit(float(b))))["bpm"]
    assert [fold(b) for b in (174, 87, 60, 128, 180, 0, -5)] == [87, 87, 120, 128, 90, 0, 0]
    assert one(spark, music.camelot(F.lit(0), F.lit(False))) == "8B" and one(spark, music.camelot(F.lit(9), F.lit(True))) == "8A"


def test_text_vectors(spark):
    n = lambda x: one(spark, text.normalize(F.lit(x)))
    assert n("Unicorn (Official Video) [4K]") == "unicorn" and n("Song feat. Someone") == "song someone" and n(None) == ""
    assert n("נועה קירל") == "נועה קירל"
    split = one(spark, text.split_title(F.lit("A - B (Official Video)"), F.lit("C - Topic")))
    assert (split["artist"], split["title"]) == ("A", "B")
    assert one(spark, text.clean_title(F.lit("2001-05 03 - Song"))) == "Song"
    assert fuzzy.token_set_ratio(["a", "b"], ["b"]) == 100.0 and fuzzy.token_set_ratio([], ["b"]) == 0.0


def test_append_once(spark):
    a = spark.createDataFrame([(1,)], "id int")
    assert store.append_once(a, spark.createDataFrame([(2,)], "id int"), "id").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        store.append_once(a, a, "id").collect()
