"""Requests to merge labels with a neighbour: each outcome on a line of voxels."""

import pytest

from voxelith.grid import Grid
from voxelith.operators import requests, working


def volumes(spark, seg, initial):
    def frame(labels):
        return spark.createDataFrame([(x, 0, 0, v) for x, v in enumerate(labels)], "x int, y int, z int, label long")

    return frame(seg), frame(initial), Grid(len(seg), 1, 1)


def run(spark, seg, initial, asked, merged=(), **options):
    s, i, g = volumes(spark, seg, initial)
    w = working.build(i, g)
    if merged:
        w = working.merge(w, w.edges.filter(f"edge_id in ({', '.join(map(str, merged))})"))
    out = requests.merge_with_neighbours(s, i, g, w, spark.createDataFrame([(a,) for a in asked], "label long"), **options)
    labels = [r["label"] for r in out.segmentation.orderBy("x").collect()]
    groups = [r["label"] for r in working.label_volume(out.initial, out.working).orderBy("x").collect()]
    return out, labels, groups


@pytest.mark.parametrize("asked, options, status", [([], {}, "nothing to merge"), ([None], {}, "nothing to merge"), ([0], {}, "failed"), ([9], {}, "failed"), ([4], {}, "nothing to merge"), ([1], {"ignored": [1]}, "failed"), ([1], {"allow_split": True}, "failed")])
def test_nothing_happens(spark, asked, options, status):
    line = [1, 1, 2, 2, 0, 4]
    out, labels, groups = run(spark, line, line, asked, **options)
    assert out.status == status and labels == groups == line and out.row().first()["status"] == status


def test_smallest_or_largest_neighbour(spark):
    line = [1, 1, 1, 2, 2, 3, 3, 3, 3]
    small, _, _ = run(spark, line, [0] * 9, [2, 2])
    assert small.plan.first()["neighbour"] == 1 and small.status == "needs insertion"
    out, labels, groups = run(spark, line, line, [2], largest=True)
    assert labels == [1] * 3 + [4] * 6 and len(set(groups[3:])) == 1


def test_groups_of_initial_labels_are_reused(spark):
    """Label 5 is a group of two initial labels."""
    out, labels, groups = run(spark, [5, 5, 5, 6, 6], [1, 1, 2, 3, 3], [6], merged=[1])
    assert (out.status, out.insertions, out.plan.first()["exact"]) == ("merged", 0, True)
    assert labels == [7] * 5 and len(set(groups)) == 1


def test_other_labels_need_insertion(spark):
    seg, initial = [5, 5, 6, 6, 6], [1, 1, 1, 2, 2]
    out, labels, _ = run(spark, seg, initial, [5])
    assert (out.status, out.insertions) == ("needs insertion", 2) and labels == seg
    out, labels, groups = run(spark, seg, initial, [5], allow_insertion=True)
    assert out.status == "merged" and labels == [7] * 5 and len(set(groups)) == 1


def test_labels_in_pieces_need_splitting(spark):
    line = [1, 1, 2, 1, 3, 3]
    out, labels, _ = run(spark, line, line, [1])
    assert (out.status, out.disconnected, out.regions) == ("needs split", 1, 2) and labels == line
    out, labels, groups = run(spark, line, line, [1], allow_insertion=True, allow_split=True)
    # both pieces of 1 are requested: each takes the smaller neighbour
    assert out.status == "merged" and out.selected == 2 and len(set(labels[:4])) == 1 and labels[4:] == [3, 3]
    assert len(set(groups[:4])) == 1 and groups[4] not in groups[:4]
