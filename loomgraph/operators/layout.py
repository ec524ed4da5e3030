"""Layout repair (survey row R4): nodes without a place, or over one that is placed before them, move to the first free cell of a grid.

What a node may keep depends on the cells that those before it moved to, so a graph is one ordered fold; graphs (``project``) are folded
in parallel. Rows stream in order and a task keeps the places of one graph, by tiles of the size of a card: a node looks at nine tiles,
and as cells are only ever taken, the search for a free one goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A card with its clearance, the grid, and how many cells are looked at.
WIDE, HIGH = 220, 140
LEFT, TOP, STEP_X, STEP_Y, COLUMNS = 80, 80, 260, 180, 4
CELLS = 10_000


class Places:
    """The places of one graph."""

    def __init__(self):
        self.tiles, self.n, self.cell = {}, 0, 0

    def taken(self, x: float, y: float) -> bool:
        a, b = int(x // WIDE), int(y // HIGH)
        near = (p for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for p in self.tiles.get((i, j), ()))
        return any(abs(x - u) < WIDE and abs(y - v) < HIGH for u, v in near)

    def put(self, x: float, y: float) -> None:
        self.tiles.setdefault((int(x // WIDE), int(y // HIGH)), []).append((x, y))
        self.n += 1

    def free(self) -> tuple[float, float]:
        while self.cell < CELLS:
            x, y = LEFT + self.cell % COLUMNS * STEP_X, TOP + self.cell // COLUMNS * STEP_Y
            if not self.taken(x, y):
                return float(x), float(y)
            self.cell += 1
        return float(LEFT), float(TOP + self.n * STEP_Y)


def repair_layout(nodes: DataFrame) -> DataFrame:
    """``project, id, x, y, moved`` of nodes ``project, ord, id, x, y``; a place that is null or not finite is none."""

    def run(batches):
        import math

        import pyarrow as pa

        project, places = None, Places()
        for b in batches:
            xs, ys, moved = [], [], []
            for now, x, y in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if (now,) != project:
                    project, places = (now,), Places()
                move = x is None or y is None or not math.isfinite(x) or not math.isfinite(y) or places.taken(x, y)
                if move:
                    x, y = places.free()
                places.put(x, y)
                xs.append(x)
                ys.append(y)
                moved.append(move)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.float64()), pa.array(ys, pa.float64()), pa.array(moved, pa.bool_())], names=["project", "id", "x", "y", "moved"])

    kind = nodes.schema["project"].dataType.simpleString()
    rows = nodes.select("project", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "ord").repartition("project").sortWithinPartitions("project", "ord", "id")
    return rows.select("project", "id", "x", "y").mapInArrow(run, f"project {kind}, id string, x double, y double, moved boolean")
