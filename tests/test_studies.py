from quantloom.operators import studies, validation


def test_allowed_ranges_leave_out_span_and_embargo():
    assert validation.allowed(0, 100, [(40, 50), (45, 60)], 5, 3) == [(0, 35), (63, 100)]
    assert validation.allowed(0, 10, [(0, 10)], 1, 1) == []


def test_levels_arm_again_far_away():
    assert studies.level_events([True, True, False, True, True], [False, False, False, True, False]) == [True, False, False, False, True]


def test_pools_join_and_break():
    out = studies.liquidity_pools([(1, 0, 100.0), (3, 2, 100.5), (9, 8, 100.2)], [(5, 99.0), (7, 101.0)], 1.0)
    assert out == [(100.25, 2, 1, 7), (100.2, 1, 9, None)]


def test_overlaps_restart_after_the_horizon():
    assert studies.overlaps([0, 5, 10, 14, 20], 10) == [False, True, False, True, False]


def test_frontier(spark):
    rows = [(1, 1, 0, 5, 0, "fill", True), (1, 2, 6, 9, 0, "fill", True), (2, 1, 0, 5, 0, "fill", True), (2, 2, 4, 9, 0, "fill", True), (3, 1, 0, 5, 0, "funding", True), (3, 2, 4, 9, 0, "funding", True), (4, 1, 0, 5, 0, "fill", False), (4, 2, 3, 3, 1, "fill", True)]
    frame = spark.createDataFrame(rows, "k int, id int, earliest int, latest int, resource int, kind string, available boolean")
    got = {r.k: (r.status, r.ids) for r in studies.causal_frontier(frame, "k").collect()}
    assert got == {1: ("SELECTED", [1]), 2: ("AMBIGUOUS", [1, 2]), 3: ("SELECTED", [1, 2]), 4: ("UNAVAILABLE", [1, 2])}


def test_blackout_knows_only_what_was_known(spark):
    points = spark.createDataFrame([("a", 1, 100), ("a", 2, 140), ("b", 3, 100)], "symbol string, id long, ms long")
    events = spark.createDataFrame([("a", 110, 120)], "symbol string, ts_ms long, first_seen_ms long")
    flag = lambda mode: {r.id: r.blackout for r in validation.blackout(points, events, 20, 30, mode).collect()}
    assert flag("tag") == {1: False, 2: True, 3: False}
    assert flag("suppress") == {1: False, 3: False}
    assert set(flag("keep").values()) == {None}
