"""The index of name pieces and the grid of neighbours against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import name_pieces, relational, spatial, worklists


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    return 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def some_names(seed, n):
    draw = random.Random(seed)
    base = ["".join(draw.choices("abé ", k=draw.randint(0, 14))) for _ in range(n // 3)]
    changed = [b[: draw.randint(0, len(b))] + draw.choice(["", "x", "ab"]) + b[draw.randint(0, len(b)) :] for b in base for _ in range(2)]
    return [(draw.choice([1, 1, 1, 2, None]), x) for x in base + changed] + [(1, None), (1, ""), (1, ""), (2, "a"), (None, "")]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.8, 1.0])
def test_edit_join(spark, threshold):
    left, right = some_names(1, 90), some_names(1, 90)[::2] + some_names(2, 60)
    frame = lambda rows: spark.createDataFrame(rows, "block int, name string").withColumn("_k", F.lit(1))
    got = {(r.block, r.left_name, r.right_name): r.score for r in name_pieces.edit_join(frame(left), frame(right), "block", threshold).collect()}
    want = {(k, a, b): score(a, b) for k, a in left for m, b in right if k is not None and k == m and a is not None and b is not None and score(a, b) >= threshold}
    assert got == want and len(got) > 20
    assert name_pieces.edit_join(frame(left).limit(0), frame(right), "block", threshold).isEmpty()


def test_edit_join_forms_only_pairs_that_share_a_piece(spark):
    """One block of names: far fewer pairs than all are compared."""
    draw = random.Random(4)
    names = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(3000)]
    frame = lambda some: spark.createDataFrame([(1, x) for x in some], "block int, name string")
    near = [x[:5] + "-" + x[7:] for x in names[:100]]
    left, right = frame(names), frame(near + [x[::-1] for x in names])
    looked = left.select("block", F.explode(name_pieces.lookups(F.col("name"), 0.8, False)).alias("_k"))
    met = looked.join(right.select("block", F.explode(name_pieces.pieces(F.col("name"), 0.8)).alias("_k")), ["block", "_k"]).count()
    assert met < 0.01 * 3000 * 3100
    found = {(r.left_name, r.right_name) for r in name_pieces.edit_join(left, right, "block", 0.8).collect()}
    assert {(a, b) for a, b in zip(names, near)} <= found


def brute(queries, rows, k, far, others):
    out = []
    for block, a, x in queries:
        found = sorted((far(x, y), b) for m, b, y in rows if m == block and not (others and a == b))
        out += [(block, a, b, f"{d:.9g}", i) for i, (d, b) in enumerate(found[:k], 1)]
    return sorted(out)


METRICS = [(spatial.euclidean, 1, lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5), (spatial.mean_difference, 0, lambda x, y: sum(abs(p - q) for p, q in zip(x, y)) / len(x))]


@pytest.mark.parametrize("dims", [1, 2, 5])
@pytest.mark.parametrize("metric", [0, 1])
def test_nearest(spark, dims, metric):
    draw = random.Random(dims)
    point = lambda: [draw.choice([0.0, 1.0, draw.gauss(0, 1), draw.gauss(5, 0.01), draw.gauss(0, 100)]) for _ in range(dims)]
    rows = [(draw.choice([1, 1, 1, 2]), i, point()) for i in range(400)] + [(1, 1000 + i, [1.0] * dims) for i in range(50)] + [(3, 2000, point())]
    queries = rows[::7] + [(2, 5000, [1e6] * dims), (9, 5001, [0.0] * dims), (3, 2000, rows[-1][2])]
    queries = list({(q[0], q[1]): q for q in queries}.values())
    near, spread, far = METRICS[metric]
    got = spatial.nearest(
        spark.createDataFrame(queries, "block int, a long, point array<double>"), spark.createDataFrame(rows, "block int, b long, point array<double>"),
        ["block"], dims, 5, near, spread=spread or dims, others=True,
    ).collect()
    assert sorted((r.block, r.a, r.b, f"{r.distance:.9g}", r.rank) for r in got) == brute(queries, rows, 5, far, True)


def test_nearest_meets_few_rows(spark):
    """Rows and queries of one block meet in few of all pairs."""
    rows = spark.range(20_000).select(F.col("id").alias("b"), F.array(F.rand(1), F.randn(2)).alias("point"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    queries = rows.where("b % 100 = 0").withColumnRenamed("b", "a")
    found = spatial.nearest(queries, rows, [], 2, 5, spatial.euclidean, others=True)
    assert found.count() == 1000
    grid = spatial.Grid(rows, 2, 5)
    start = found.where("rank = 5").select("a", F.col("distance").alias("_far")).join(queries, "a").withColumn("level", F.lit(grid.levels))
    cells = grid.within(start, F.col("_far"))
    assert cells.count() <= 36 * 200
    met = cells.join(grid.cells(rows.withColumnRenamed("point", "p").withColumn("point", F.col("p"))).select("b", "level", "cell"), ["level", "cell"]).count()
    assert met < 0.05 * 200 * 20_000


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, point array<double>")
    some = spark.createDataFrame([(1, 1, [0.0])], "a long, b long, point array<double>")
    for q, r in ((none, some), (some, none), (none, none)):
        assert spatial.nearest(q, r, [], 1, 3, spatial.euclidean).isEmpty()


def test_nearest_neighbours_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 5.0), (3, None, 5.0), (4, 1.0, 5.0), (None, 2.0, 5.0), (5, 9.0, 5.0)], "k long, x double, c double")
    got = relational.nearest_neighbours(rows.where("k = 1"), rows, "k", ["x", "c"], 2).collect()
    assert [(r.a, r.b, r.rank) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1), (1, 4, 2)]
    assert relational.nearest_neighbours(rows.limit(0), rows.limit(0), "k", ["x"]).isEmpty()


def test_mutual_nearest(spark):
    draw = random.Random(11)
    left = [(draw.choice([1, 1, 2, None]), i, draw.choice([None, 1.0, draw.gauss(0, 9)]), draw.gauss(0, 9)) for i in range(120)]
    right = [(draw.choice([1, 1, 2, None]), f"n{i:03}", draw.choice([None, 1.0, draw.gauss(0, 9)]), draw.choice([0.0, draw.gauss(0, 9)])) for i in range(90)]
    cost = lambda x, y: (abs(x[2] - y[2]) + abs(x[3] - y[3])) / 2
    meet = lambda x, y: None not in (x[0], x[2], y[2]) and x[0] == y[0]
    of_code = {x[1]: min((cost(x, y), y[1]) for y in right if meet(x, y)) for x in left if any(meet(x, y) for y in right)}
    of_name = {y[1]: min((cost(x, y), x[1]) for x in left if meet(x, y)) for y in right if any(meet(x, y) for x in left)}
    want = {(c, n, f"{d:.9g}") for c, (d, n) in of_code.items() if of_name[n][1] == c}
    got = worklists.mutual_nearest(spark.createDataFrame(left, "block int, code int, x double, y double"), spark.createDataFrame(right, "block int, name string, x double, y double"), "block", ["x", "y"]).collect()
    assert {(r.code, r.name, f"{r.cost:.9g}") for r in got} == want and len(want) > 10


def test_closest_names(spark):
    frame = lambda rows: spark.createDataFrame(rows, "region string, name string")
    targets = frame([("r", "Northfield"), ("r", "Northfeld East"), ("r", "Oak"), ("q", "Northfield"), ("r", None), (None, "Oak")])
    names = frame([("r", "Northfield East"), ("r", "Northfields"), ("r", "Oax"), ("r", "Oaxx"), ("r", None), (None, "Oak")])
    got = {(r.region, r.name): (r.closest, round(r.score, 4)) for r in worklists.closest_names(targets, names, "region", 0.6).collect()}
    assert got == {("r", "Northfield"): ("Northfields", 0.9091), ("r", "Northfeld East"): ("Northfield East", 0.9333), ("r", "Oak"): ("Oax", 0.6667)}
    assert worklists.closest_names(targets, names.limit(0), "region").isEmpty()
