"""Road lines: goldens of the kernels, bridged gaps against brute force."""

import itertools
import math

import numpy as np
import pytest

from roadweft.operators import lines
from roadweft.plans.lines import QUERIES


def test_one_repeat_cuts_once():
    assert lines.split_repeats(list("aabcb")) == [["a", "b", "c"], ["b"]]


def test_piece_before_the_last_cut_is_lost():
    # the pair a, b comes again at the second and the third step, at places 2 and 3
    assert lines.split_repeats(list("ababx")) == [["a", "b"], ["b", "x"]]
    # b, a comes again at place 5, c, d at place 7: what lies between them is lost
    assert lines.split_repeats(list("abcdbacdx")) == [list("abcdb"), list("dx")]


def test_no_repeat_is_one_piece():
    assert lines.split_repeats(list("abc")) == [["a", "b", "c"]]
    assert lines.split_repeats([]) == [[]]


def test_snap_follows_the_pixels():
    pixels = np.array([[0, 0], [0, 3], [0, 6], [5, 6], [9, 6]])
    line = lines.snap_line(pixels, np.array([9.7, 6.2]), np.array([0.4, 0.0]))
    assert line.tolist() == [[0, 0], [0, 6], [9, 6]]


def test_few_pixels_are_a_straight_line():
    assert lines.snap_line(np.array([[1, 1], [2, 2]]), np.array([0.9, 1.0]), np.array([4.0, 5.5])).tolist() == [[0, 1], [4, 5]]


def test_merge_turns_pieces():
    got = lines.merge_lines([[(0, 0), (1, 0)], [(3, 0), (1, 0)], [(3, 0), (4, 1)]])
    assert got == [[(0, 0), (1, 0), (3, 0), (4, 1)]]


def test_merge_stops_at_a_fork_and_closes_a_ring():
    fork = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]]
    assert sorted(lines.merge_lines(fork)) == sorted(fork)
    (ring,) = lines.merge_lines([[(0, 0), (1, 0)], [(1, 0), (0, 1)], [(0, 1), (0, 0)]])
    assert ring[0] == ring[-1] and len(ring) == 4


def test_image_without_roads():
    assert lines.image_edges(1, np.zeros((20, 20), np.uint8)).empty


def test_short_spurs_go_unless_at_the_rim():
    mask = np.zeros((60, 60), np.uint8)
    mask[30, 5:55] = 1
    mask[25:30, 30] = 1
    got = lines.image_edges(1, mask, least_spur=10)
    assert all(abs(y - 30) <= 2 for y in [*got.yu, *got.yv])
    rim = np.zeros((60, 60), np.uint8)
    rim[30, 0:55] = 1
    rim[0:4, 30] = 1
    assert len(lines.image_edges(1, rim, least_spur=100)) >= 1


EDGES = "image_id bigint, u bigint, v bigint, key int, weight double, yu double, xu double, yv double, xv double, ys array<int>, xs array<int>"


def road(image, u, v, a, b, key=0):
    return (image, u, v, key, math.dist(a, b), *map(float, (*a, *b)), [a[0], b[0]], [a[1], b[1]])


@pytest.mark.parametrize(
    ("second", "joined"),
    [
        (((100, 110), (100, 230)), True),  # 10 apart
        (((100, 124), (100, 230)), False),  # 24 apart is excluded
        (((100, 150), (100, 250)), True),  # 50 apart in line
        (((100, 150), (240, 150)), False),  # 50 apart, at a right angle
    ],
)
def test_gap(spark, second, joined):
    edges = spark.createDataFrame([road(1, 0, 1, (100, 0), (100, 100)), road(1, 2, 3, *second)], EDGES)
    rows = lines.bridges(edges).collect()
    assert bool(rows) == joined
    if joined:
        assert rows[0].wkt == f"LINESTRING (100.0 100.0, {second[0][1]}.0 100.0)"


def test_bridges_equal_brute_force(spark, sf_dir):
    edges = QUERIES["gr_img2g"](spark, sf_dir)
    rows = edges.collect()
    assert rows
    degree, end, linked = {}, {}, set()
    for r in rows:
        u, v = (r.image_id << 32) + r.u, (r.image_id << 32) + r.v
        linked.add((u, v))
        for a, pa, pb in ((u, (r.yu, r.xu), (r.yv, r.xv)), (v, (r.yv, r.xv), (r.yu, r.xu))):
            degree[a] = degree.get(a, 0) + 1
            end[a] = (pa, pb)
    pairs = []
    for s, e in itertools.combinations(sorted(a for a in degree if degree[a] == 1), 2):
        if s >> 32 != e >> 32 or (s, e) in linked:
            continue
        (p, p2), (q, q2) = end[s], end[e]
        d = math.dist(p, q)
        first, second = np.subtract(p2, p), np.subtract(q2, q)
        gap = np.subtract(q, p)
        off = abs(first[0] * gap[1] - first[1] * gap[0]) / np.hypot(*first) if first.any() else 0
        angle = abs(math.degrees(math.atan2(first[0] * second[1] - first[1] * second[0], first @ second)))
        if 0 < d < 24 or (24 < d < 80 and off <= 24 and (angle < 30 or angle > 150)):
            pairs.append((d, s, e))
    used, want = set(), set()
    for _, s, e in sorted(pairs):
        if not {s, e} & used:
            used |= {s, e}
            want.add((s, e))
    assert {(r.s, r.e) for r in lines.bridges(edges).collect()} == want


def test_parallel_edges_and_empty_images(spark):
    twice = [road(1, 0, 1, (0, 0), (0, 9)), road(1, 0, 1, (0, 0), (0, 9), 1)]
    assert [r.wkt for r in lines.graph_lines(spark.createDataFrame(twice, EDGES), bridge=False).collect()] == ["LINESTRING (0.0 0.0, 9.0 0.0)"]
    assert lines.graph_lines(spark.createDataFrame([], EDGES)).count() == 0
