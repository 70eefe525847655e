"""What the create flow reads for one set."""

from cadenza.plans import sets


def test_created_reads_its_own_tracks(spark):
    """Sections and lengths of tracks that the set does not hold are left before any of them is ordered."""
    clips = sets.created(spark, "/root/testdata/sf0.001")["clips"]
    plan = clips._jdf.queryExecution().optimizedPlan().toString().splitlines()
    read = [i for i, line in enumerate(plan) if "Relation [l_orderkey" in line]
    assert len(read) >= 3
    for i in read:
        above = next(line for line in reversed(plan[:i]) if "Filter" in line)
        assert "l_partkey" in above and (" IN (" in above or " INSET " in above)
    assert clips.count() > 0
