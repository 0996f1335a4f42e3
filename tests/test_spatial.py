"""Spatial operators on small literal pages."""

import pytest

from quillgrid.functions import geometry as G
from quillgrid.operators import cluster, spatial

BOX = "page long, seq long, x double, y double, w double, h double"
ANCHOR = "page long, seq long, text string, x double, y double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], BOX)


def anchors(spark, *rows):
    return spark.createDataFrame([(1, i, t, float(x), float(y)) for i, (t, x, y) in enumerate(rows)], ANCHOR)


def ys(df):
    return sorted(r.y for r in df.collect())


@pytest.mark.parametrize(
    "labels,wanted",
    [
        ([("\x00\x01\x02", 105, 196), ("TIN", 108, 195)], "TIN"),
        ([("2", 110, 196), ("שם מלא", 230, 202)], "שם מלא"),
        ([("1.2.", 100, 195)], ""),
        ([("under", 100, 190), ("beside", 60, 212)], "under"),
        ([("far below", 100, 100)], ""),
    ],
)
def test_nearest_label(spark, labels, wanted):
    out = spatial.nearest_label(boxes(spark, (100, 200, 120, 12)), anchors(spark, *labels)).collect()
    assert [r.label for r in out] == [wanted]


def test_stacked_lines_are_all_kept(spark):
    own = boxes(spark, *[(70, y, 375, 12) for y in (495, 481, 467, 453)])
    text = anchors(spark, ("Details:", 450, 510))
    assert ys(spatial.stacked_lines(own, text)) == [453, 467, 481, 495]
    assert ys(spatial.fillable(own, text)) == [453, 467, 481, 495]


def test_overlap_is_strict_and_containment_is_not(spark):
    own, other = boxes(spark, (0, 0, 10, 10), (10, 0, 10, 10), (100, 100, 5, 5)), boxes(spark, (15, 5, 10, 10))
    assert sorted((r.x, r.y) for r in spatial.not_overlapping(own, other).collect()) == [(0, 0), (100, 100)]
    assert [r.x for r in spatial.containing(own, anchors(spark, ("t", 10, 10))).collect()] in ([0, 10], [10, 0])
    assert spatial.containing(own, anchors(spark, ("t", 10, 10)), 2).count() == 0
    assert spatial.not_overlapping(own, other.limit(0)).count() == 3


def test_grouped_checkboxes(spark):
    own = boxes(spark, (50, 515, 14.7, 14.7), (50, 475, 14.7, 14.7), (50, 435, 14.7, 14.7), (300, 100, 14.7, 14.7))
    assert ys(spatial.grouped_checkboxes(own)) == [435, 475, 515]


def test_squares_from_segments(spark):
    rows = [(1, 0, 0, 12, 0), (1, 0, 12, 12, 12), (1, 0, 0, 0, 12), (1, 12, 0, 12, 12), (1, 50, 50, 62, 50), (1, 50, 62, 62, 62)]
    out = spatial.squares(spark.createDataFrame([tuple(map(float, r)) for r in rows], "page double, x0 double, y0 double, x1 double, y1 double"))
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 12, 12)]


def test_context_rows_take_the_closest_row(spark):
    specs = spark.createDataFrame([(11, "a", "text", 50.0, 280.0, 100.0, 20.0), (11, "b", "text", 200.0, 280.0, 100.0, 20.0), (11, "c", "text", 50.0, 268.0, 100.0, 5.0)], "page long, name string, type string, x double, y double, w double, h double")
    contexts = spark.createDataFrame([(1, 11, float("-inf"), float("inf"), 336.0, "any")], "cid long, page long, x0 double, x1 double, y double, direction string")
    assert sorted(r.name for r in spatial.context_rows(specs, contexts).collect()) == ["a", "b"]


def test_greedy_dedupe_keeps_first(spark):
    own = boxes(spark, (0, 0, 100, 20), (1, 1, 100, 20), (2, 2, 100, 20), (3, 3, 100, 20), (50, 300, 100, 20))
    kept = cluster.greedy_kept(own, G.near_duplicates, ["seq"])
    assert sorted((r.x, r.y) for r in kept.collect()) == [(0, 0), (2, 2), (50, 300)]  # the third shares less than nine tenths with the first


def test_gap_clusters_chain(spark):
    rows = [(1, float(x)) for x in (10, 12, 15, 18, 30, 31)]
    out = {r.x: r.snapped for r in cluster.snapped(spark.createDataFrame(rows, "page long, x double")).collect()}
    assert out == {10: 13.75, 12: 13.75, 15: 13.75, 18: 13.75, 30: 30.5, 31: 30.5}


def test_runs_and_merging(spark):
    bits = spark.createDataFrame([(1, p) for p in (3, 4, 5, 9, 10, 20, 21, 22, 23)], "page long, pos long")
    assert sorted((r.begin, r.n) for r in cluster.runs(bits, ["page"], "pos", 3).collect()) == [(3, 3), (20, 4)]
    found = spark.createDataFrame([(1, 10, 0, 100), (1, 12, 5, 95), (1, 13, 80, 200), (1, 20, 0, 100)], "page long, row long, x0 long, x1 long")
    assert sorted(tuple(r) for r in cluster.merged_runs(found).collect()) == [(1, 10, 12, 0, 100), (1, 13, 13, 80, 200), (1, 20, 20, 0, 100)]


def test_walk_stops_at_wide_gaps(spark):
    words = [(1, 100.0, 60.0, 95.0, "Name"), (1, 100.0, 10.0, 55.0, "Full"), (1, 100.0, -200.0, -60.0, "far"), (1, 100.0, 90.0, 110.0, "over")]
    pairs = spark.createDataFrame(words, "box long, edge double, x0 double, x1 double, text string")
    assert [r.label for r in cluster.walked_labels(pairs, ["box"]).collect()] == ["Full Name"]


def test_labels_meet_wide_boxes_in_one_join_and_few_bands(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 100.0, 100_000.0, 10.0), (1, 2, 0.0, 200.0, 50.0, -60.0)], "page long, seq long, x double, y double, w double, h double")
    anchors = spark.createDataFrame([(1, 1, 90_000.0, 95.0, "Surname"), (1, 2, 10.0, 190.0, "Town")], "page long, seq long, x double, y double, text string")
    for find, seqs in ((spatial.with_label, [1, 2]), (spatial.with_conflict, [])):
        found = find(boxes, anchors)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and "sequence(" in plan and plan.count("Generate") == 1
        assert sorted(r.seq for r in found.collect()) == seqs
