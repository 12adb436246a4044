"""Road lines: graphs of masks, straightened and split lines, merged pieces, bridged gaps.

An image's graph is small, so what needs all of it runs per image; gaps are bridged by an equi-join
on grid cells over all images at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.operators import kernels
from roadweft.operators.graph import greedy_match

EDGE = "image_id bigint, u bigint, v bigint, key int, weight double, yu double, xu double, yv double, xv double, ys array<int>, xs array<int>"
EMPTY = "LINESTRING EMPTY"


def image_edges(image_id: int, mask: np.ndarray, least_spur: float = 10.0, rounds: int = 8, border: int = 4) -> pd.DataFrame:
    """Edges (schema EDGE) of a mask's skeleton without short spurs and loops.

    A round drops the dead ends whose edge is shorter than ``least_spur``, except edges with an end
    within ``border`` pixels of the image's rim; rounds end when nothing is dropped."""
    return skeleton_edges(image_id, kernels.thin(mask), least_spur, rounds, border)


def skeleton_edges(image_id: int, skeleton: np.ndarray, least_spur: float = 10.0, rounds: int = 8, border: int = 4) -> pd.DataFrame:
    """`image_edges` of a skeleton."""
    nodes, edges = kernels.skeleton_paths(skeleton)
    edges = [(*e, kernels.path_length(e[2])) for e in edges]
    high = max(skeleton.shape) - border
    at_rim = lambda k: any(c < border or c > high for c in nodes[k])
    for _ in range(rounds):
        degree = Counter(k for u, v, *_ in edges for k in (u, v))
        gone = {k for u, v, _, w in edges for k in (u, v) if degree[k] == 1 and w < least_spur and not at_rim(u) and not at_rim(v)}
        if not gone:
            break
        edges = [e for e in edges if not gone & {e[0], e[1]}]
    turned = [e if e[0] < e[1] else (e[1], e[0], e[2][::-1], e[3]) for e in edges if e[0] != e[1]]
    out, keys = [], Counter()
    for u, v, pixels, w in sorted(turned, key=lambda e: (e[0], e[1], e[3], e[2].tolist())):
        out.append((image_id, u, v, keys[u, v], w, *nodes[u], *nodes[v], pixels[:, 0].tolist(), pixels[:, 1].tolist()))
        keys[u, v] += 1
    return pd.DataFrame(out, columns=[c.split()[0] for c in EDGE.split(", ")])


def snap_line(pixels: np.ndarray, s: np.ndarray, e: np.ndarray, epsilon: float = 2.0) -> np.ndarray:
    """``pixels`` straightened, in whole numbers, its ends moved to ``s`` and ``e``, whichever order
    suits its direction; at most three pixels become the line from ``s`` to ``e``."""
    if len(pixels) <= 3:
        return np.array([s, e]).astype(int)
    # a point at exactly epsilon goes, hence the next larger number
    line = kernels.simplify_line(np.asarray(pixels, float), np.nextafter(epsilon, np.inf)).astype(int)
    if np.hypot(*(line[0] - s)) > np.hypot(*(line[-1] - s)):
        s, e = e, s
    line[0], line[-1] = np.trunc(s), np.trunc(e)
    return line


def split_repeats(sequence: list) -> list[list]:
    """The pieces of a sequence (runs of equal elements count once) that is cut where a pair of
    neighbours, in either order, comes again. Of several cuts the piece before the last one is
    lost, as are inner pieces of one element."""
    items = [p for k, p in enumerate(sequence) if not k or p != sequence[k - 1]]
    seen: set[frozenset] = set()
    cuts = []
    for k, pair in enumerate(zip(items, items[1:]), 1):
        if frozenset(pair) in seen:
            cuts.append(k)
        seen.add(frozenset(pair))
    bounds = [0, *cuts, len(items)]
    pieces = [items[a:b] for a, b in zip(bounds, bounds[1:])]
    return pieces if len(cuts) < 2 else [pieces[0], *(p for p in pieces[1:-2] if len(p) > 1), pieces[-1]]


def merge_lines(pieces: list) -> list[list[tuple]]:
    """Lines joined, turned where needed, at every point where exactly two ends meet."""
    lines = [[tuple(p) for p in piece] for piece in pieces]
    meets = Counter(end for line in lines for end in (line[0], line[-1]))
    out = []
    while lines:
        line = lines.pop(0)
        for _ in range(2):  # grow at the end, then at the start
            while meets[line[-1]] == 2 and line[0] != line[-1]:
                k = next((k for k, other in enumerate(lines) if line[-1] in (other[0], other[-1])), None)
                if k is None:
                    break
                more = lines.pop(k)
                line += (more if more[0] == line[-1] else more[::-1])[1:]
            line.reverse()
        out.append(line)
    return out


def _wkt(points: list[str]) -> str:
    return f"LINESTRING ({', '.join(points)})"


def image_lines(edges: pd.DataFrame) -> list[str]:
    """WKT lines of one image's edges: chains of edges that follow one another, straightened, split
    at repeated segments; further edges between the same nodes are lines of their own unless they
    are part of another line in either direction."""
    around = defaultdict(list)
    for row in edges.sort_values(["u", "v", "key"]).itertuples():
        ends = np.array([row.yu, row.xu]), np.array([row.yv, row.xv])
        line = snap_line(np.stack([row.ys, row.xs], 1), *ends)
        if len(line) > 2 or (line[0] != line[1]).any():
            around[row.u, row.v].append([f"{x:.1f} {y:.1f}" for y, x in line])
    chains: list[list] = []
    before = None
    for pair in sorted(set(zip(edges.u, edges.v))):
        if pair[0] != before:
            chains.append([])
        chains[-1].append(pair)
        before = pair[1]
    out: list[str] = []
    for chain in chains:
        main = [p for pair in chain for p in (around[pair] or [[]])[0]]
        out += [_wkt(p) for p in split_repeats(main) if len(p) > 1]
        for more in (m for pair in chain for m in around[pair][1:]):
            if not any(", ".join(way) in line for line in out for way in (more, more[::-1])):
                out.append(_wkt(more))
    return out


def without_parts(parallel: DataFrame, *by: str) -> DataFrame:
    """``parallel`` (by..., key, points as texts) without the lines that are part, in either direction,
    of another of the same edge (by...) with a smaller key. An edge's parallel lines are few, so they
    meet in one row."""
    text = lambda points: F.array_join(points, ", ")
    every = parallel.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "points"))).alias("every"))
    part = lambda a, b: (b["key"] < a["key"]) & (F.contains(text(b["points"]), text(a["points"])) | F.contains(text(b["points"]), text(F.reverse(a["points"]))))
    kept = F.filter("every", lambda a: ~F.exists("every", lambda b: part(a, b)))
    return every.select(*by, F.explode(kept).alias("l")).select(*by, "l.key", "l.points")


def dead_ends(edges: DataFrame) -> DataFrame:
    """(image_id, id, y, x, y2, x2): nodes of one edge, and where that edge leads; ids are unique
    over all images of fewer than 2^32 nodes each."""
    ident = lambda c: F.shiftleft("image_id", 32) + F.col(c)
    ends = edges.select("image_id", F.explode(F.array(
        F.struct(ident("u").alias("id"), F.col("yu").alias("y"), F.col("xu").alias("x"), F.col("yv").alias("y2"), F.col("xv").alias("x2")),
        F.struct(ident("v").alias("id"), F.col("yv").alias("y"), F.col("xv").alias("x"), F.col("yu").alias("y2"), F.col("xu").alias("x2")),
    )).alias("e")).select("image_id", "e.*")
    first = [F.min(c).alias(c) for c in ("y", "x", "y2", "x2")]
    return ends.groupBy("image_id", "id").agg(*first, F.count(F.lit(1)).alias("degree")).filter("degree = 1").drop("degree")


def gap_pairs(ends: DataFrame, edges: DataFrame, near: float = 24.0, far: float = 80.0, straight: float = 30.0) -> DataFrame:
    """(image_id, s, e, d) of dead ends, not joined by an edge, that are under ``near`` apart; or
    over ``near`` and under ``far`` apart, at most ``near`` off the line of the other's edge, with
    edges within ``straight`` degrees of one line."""
    cells = ends.withColumn("cy", F.floor(F.col("y") / far)).withColumn("cx", F.floor(F.col("x") / far))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = cells.withColumn("cy", F.explode(F.transform(step, lambda k: F.col("cy") + k))).withColumn("cx", F.explode(F.transform(step, lambda k: F.col("cx") + k)))
    a, b = spread.alias("a"), cells.alias("b")
    pairs = a.join(b, F.expr("a.image_id = b.image_id AND a.cy = b.cy AND a.cx = b.cx AND a.id < b.id")).selectExpr(
        "a.image_id", "a.id AS s", "b.id AS e", "a.y AS sy", "a.x AS sx", "b.y AS ey", "b.x AS ex",
        "a.y2 - a.y AS ay", "a.x2 - a.x AS ax", "b.y2 - b.y AS dy", "b.x2 - b.x AS dx", "sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d",
    )
    off = F.expr("coalesce(abs((ay * (ex - sx) - ax * (ey - sy)) / nullif(sqrt(ay * ay + ax * ax), 0D)), 0D)")
    angle = F.abs(F.degrees(F.atan2(F.expr("ay * dx - ax * dy"), F.expr("ay * dy + ax * dx"))))
    aligned = (F.col("d") > near) & (F.col("d") < far) & (off <= near) & ((angle < straight) | (angle > 180 - straight))
    wanted = pairs.filter(((F.col("d") > 0) & (F.col("d") < near)) | aligned)
    joined = edges.select(F.expr("shiftleft(image_id, 32) + least(u, v)").alias("_s"), F.expr("shiftleft(image_id, 32) + greatest(u, v)").alias("_e"))
    return wanted.join(joined, F.expr("s = _s AND e = _e"), "left_anti").select("image_id", "s", "e", "d", "sy", "sx", "ey", "ex")


def bridges(edges: DataFrame, **limits: float) -> DataFrame:
    """(image_id, s, e, d, wkt): gaps closed from the shortest on, each dead end at most once."""
    pairs = gap_pairs(dead_ends(edges), edges, **limits)
    taken = greedy_match(pairs).select(F.col("s").alias("_s"), F.col("e").alias("_e"))
    kept = pairs.join(taken, F.expr("s = _s AND e = _e"), "left_semi")
    at = lambda c: F.format_string("%d.0", F.col(c).cast("int"))
    point = lambda k: F.concat(at(f"{k}x"), F.lit(" "), at(f"{k}y"))
    return kept.select("image_id", "s", "e", "d", F.concat(F.lit("LINESTRING ("), point("s"), F.lit(", "), point("e"), F.lit(")")).alias("wkt"))


def graph_lines(edges: DataFrame, bridge: bool = True) -> DataFrame:
    """(image_id, wkt): all lines of every image's graph, bridged gaps included."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "wkt": image_lines(rows)})

    own = edges.groupBy("image_id").applyInPandas(step, "image_id bigint, wkt string")
    return own.unionByName(bridges(edges).select("image_id", "wkt")) if bridge else own
