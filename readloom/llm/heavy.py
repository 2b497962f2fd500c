"""Most frequent values of very large columns in bounded memory: a majority-vote sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash rows and cells per row of the sketch. A row's noise is about rows / WIDTH, far below the usual shares.
DEPTH, WIDTH = 4, 2048
#: Input rows tallied at once before they are put into the sketch.
TALLY_ROWS = 200_000

_CELL = "field string, row int, cell int, candidate string, total long, surplus long"


def _vote(cells: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tallied values by cell: total, position of the leader (-1: none) and its surplus of votes over all others."""
    total = np.bincount(cells, counts, width).astype("int64")
    order = np.lexsort((counts, cells))
    last = np.flatnonzero(np.r_[cells[order][1:] != cells[order][:-1], True]) if len(order) else order
    leader = np.full(width, -1, "int64")
    leader[cells[order[last]]] = order[last]
    surplus = np.where(leader >= 0, 2 * counts[leader] - total, 0) if len(counts) else np.zeros(width, "int64")
    return total, leader, np.maximum(surplus, 0)


class Sketch:
    """depth x width cells of total, candidate and vote surplus for one field."""

    def __init__(self, depth: int, width: int):
        self.total = np.zeros((depth, width), "int64")
        self.surplus = np.zeros((depth, width), "int64")
        self.candidate = np.full((depth, width), None, object)

    def add(self, values: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        depth, width = self.total.shape
        for r in range(depth):
            total, leader, surplus = _vote(cell_of(hashes, r, width), counts, width)
            has = leader >= 0
            name = np.full(width, None, object)
            name[has] = values[leader[has]]
            self.merge_row(r, total, name, surplus)

    def merge_row(self, r: int, total: np.ndarray, name: np.ndarray, surplus: np.ndarray) -> None:
        """Votes of equal candidates add up; else the weaker's votes cancel as many of the stronger's."""
        mine, held = self.surplus[r], self.candidate[r]
        same = held == name
        stronger = ~same & (surplus > mine)
        self.total[r] += total
        self.candidate[r] = np.where(stronger, name, held)
        self.surplus[r] = np.where(same, mine + surplus, np.abs(mine - surplus))


def cell_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of 64-bit hashes in a row: 16 of their bits each, width at most 65536."""
    return ((hashes.astype("uint64") >> np.uint64(16 * row)) & np.uint64(width - 1)).astype("int64")


def _sketches(labels: list[str], depth: int, width: int, tally_rows: int):
    """mapInArrow: rows (v0, h0, v1, h1, ...) -> the used cells of each field's sketch, and row -1 with the row count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch(depth, width) for _ in labels]
        held: list[pa.RecordBatch] = []
        rows = seen = 0

        def tally() -> None:
            t = pa.Table.from_batches(held)
            for i, s in enumerate(sketches):
                g = t.select([f"v{i}", f"h{i}"]).group_by([f"v{i}", f"h{i}"]).aggregate([([], "count_all")])
                g = g.filter(g[f"v{i}"].is_valid())
                if len(g):
                    s.add(g[f"v{i}"].to_numpy(zero_copy_only=False), g[f"h{i}"].to_numpy(), g["count_all"].to_numpy())

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            seen += b.num_rows
            if rows >= tally_rows:
                tally()
                held, rows = [], 0
        if held:
            tally()
        for label, s in zip(labels, sketches, strict=True):
            r, c = np.nonzero(s.total)
            names = s.candidate[r, c]
            names[s.surplus[r, c] == 0] = None  # without surplus a candidate has no vote to bring into a merge
            n = len(r)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * (n + 1)), pa.array(np.r_[r, -1].astype("int32")), pa.array(np.r_[c, 0].astype("int32")),
                 pa.array([*names, None], pa.string()), pa.array(np.r_[s.total[r, c], seen]), pa.array(np.r_[s.surplus[r, c], 0])],
                names=["field", "row", "cell", "candidate", "total", "surplus"],
            )

    return run


def merge_cells(cells: DataFrame) -> DataFrame:
    """Cells of many sketches to one sketch by vote cancellation; the result can be merged again, in any order.

    The surpluses of each candidate add up; the leader keeps what the votes for all others leave. Totals add up.
    """
    per = cells.groupBy("field", "row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("surplus"))
    top = F.max(F.when(F.col("candidate").isNotNull(), F.struct("surplus", "candidate")))
    one = per.groupBy("field", "row", "cell").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"), top.alias("top"))
    left = F.greatest(F.lit(0), 2 * F.coalesce("top.surplus", F.lit(0)) - F.col("votes"))
    return one.select("field", "row", "cell", F.when(left > 0, F.col("top.candidate")).alias("candidate"), "total", left.alias("surplus"))


def vote_sketch(df: DataFrame, fields: dict[str, Column], *, depth: int = DEPTH, width: int = WIDTH, tally_rows: int = TALLY_ROWS) -> DataFrame:
    """The merged sketch of the fields: at most depth * width cells each (row -1: the number of input rows).

    One pass; each task holds one sketch per field and a tally of at most `tally_rows` rows, whatever the
    number of distinct values. Sketches of separate files or days merge by `merge_cells(a.unionByName(b))`.
    """
    if not (1 <= depth <= 4 and 2 <= width <= 65536 and width & (width - 1) == 0):
        raise ValueError("depth must be 1 to 4, width a power of two up to 65536")
    cols = []
    for i, c in enumerate(fields.values()):
        cols += [c.cast("string").alias(f"v{i}"), F.xxhash64(c.cast("string")).alias(f"h{i}")]
    return merge_cells(df.select(*cols).mapInArrow(_sketches(list(fields), depth, width, tally_rows), _CELL))


def _bounds(width: int, share: float):
    """applyInPandas over the sketch of one field: candidates that may reach the share, and what may hide others.

    A value that leads no cell has at most (total - surplus) / 2 rows in each of its cells. Where some hash row has no
    cell that leaves room for `share` of the rows, all values are candidates. Else the open cells come too, with
    null values: at most 1 / (2 share) a hash row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int(pdf.loc[pdf["row"] == -1, "total"].sum())
        cells = pdf[pdf["row"] >= 0]
        depth = int(cells["row"].max()) + 1 if len(cells) else 0
        total, surplus = np.zeros((depth, width), "int64"), np.zeros((depth, width), "int64")
        held = np.full((depth, width), None, object)
        r, c = cells["row"].to_numpy(), cells["cell"].to_numpy()
        total[r, c], surplus[r, c] = cells["total"], cells["surplus"]
        held[r, c] = cells["candidate"].to_numpy(object)
        known = cells.dropna(subset=["candidate"]).drop_duplicates("candidate")
        names = known["candidate"].to_numpy(object)
        h = known["hash"].to_numpy("int64")
        lower, upper = np.zeros(len(names), "int64"), np.full(len(names), rows, "int64")
        for k in range(depth):
            at = cell_of(h, k, width)
            mine = held[k, at] == names
            sign = np.where(mine, surplus[k, at], -surplus[k, at])
            upper = np.minimum(upper, (total[k, at] + sign) // 2)
            lower = np.maximum(lower, np.where(mine, surplus[k, at], 0))
        out = pd.DataFrame({"value": names, "lower": lower, "upper": upper, "row": -1, "cell": 0})[upper >= share * rows]
        room = (total - surplus) // 2
        k, c = np.nonzero((room >= share * rows) & (room > 0))
        if depth and len(set(k.tolist())) == depth:
            others = pd.DataFrame({"value": np.full(len(k), None, object), "lower": 0, "upper": room[k, c], "row": k, "cell": c})
            out = pd.concat([out, others], ignore_index=True)
        return out.assign(field=pdf["field"].iloc[0], n_rows=rows)[["field", "value", "lower", "upper", "n_rows", "row", "cell"]]

    return run


def _survey(df: DataFrame, fields: dict[str, Column], share: float, depth: int, width: int, tally_rows: int) -> DataFrame:
    if not 0 < share <= 1:
        raise ValueError("share must be above 0, at most 1")
    sketch = vote_sketch(df, fields, depth=depth, width=width, tally_rows=tally_rows).withColumn("hash", F.xxhash64("candidate"))
    return sketch.groupBy("field").applyInPandas(_bounds(width, share), "field string, value string, lower long, upper long, n_rows long, row int, cell int")


def heavy_values(df: DataFrame, fields: dict[str, Column], share: float, *, depth: int = DEPTH, width: int = WIDTH, tally_rows: int = TALLY_ROWS) -> DataFrame:
    """Values that may hold at least `share` of all rows: field, value, lower, upper, n_rows.

    lower <= true count <= upper always. A field for which the sketch can't rule out that further values reach the
    share, as they lead no cell, gets a row with a null value too, whose upper bounds the count of any such value;
    without that row every value of at least `share` of the rows is listed. A greater width makes it rarer.

    Nulls are no values but count as rows; equal values count together however they repeat; ties among candidates
    go to the greater string. An empty table gives an empty result. Other columns of `df` aren't read, whatever
    their names.
    """
    found = _survey(df, fields, share, depth, width, tally_rows)
    cells = found.where("value is null").groupBy("field", "row").agg(F.max("upper").alias("upper"), F.max("n_rows").alias("n_rows"))
    others = cells.groupBy("field").agg(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("lower"), F.min("upper").alias("upper"), F.max("n_rows").alias("n_rows"))
    return found.where("value is not null").select("field", "value", "lower", "upper", "n_rows").unionByName(others)


def frequent_values(df: DataFrame, fields: dict[str, Column], share: float, *, depth: int = DEPTH, width: int = WIDTH, tally_rows: int = TALLY_ROWS) -> DataFrame:
    """Exactly the values whose count reaches `share` of all rows: field, value, lower, upper.

    The bounds of the sketch decide most of them. Two kinds are counted exactly, in a second pass: candidates with
    `share` between their bounds, and, where the sketch can't rule out further values, all values whose cells
    are open in every hash row; their bounds become their count. So no value is missed, whatever the width. What
    comes to the driver are candidates and open cells that may reach the share: at most depth / share a field.
    """
    spark = df.sparkSession
    found = _survey(df, fields, share, depth, width, tally_rows).collect()
    reach = {r.field: r.n_rows * share for r in found}
    sure = [(r.field, r.value, r.lower, r.upper) for r in found if r.value is not None and r.lower >= reach[r.field]]
    ask = [(r.field, r.value) for r in found if r.value is not None and r.lower < reach[r.field]]
    cells: dict[str, dict[int, list[int]]] = {}
    for r in found:
        if r.value is None:
            cells.setdefault(r.field, {}).setdefault(r.row, []).append(r.cell)
    out = spark.createDataFrame(sure, "field string, value string, lower long, upper long")
    if not ask and not cells:
        return out
    # Few strings and few cells a row: hashed sets within the compiled scan, no join.
    per = []
    for name, c in fields.items():
        text = c.cast("string")
        hidden = F.lit(name in cells)
        for k, at in cells.get(name, {}).items():
            hidden = hidden & F.shiftrightunsigned(F.xxhash64(text), 16 * k).bitwiseAND(F.lit(width - 1)).isin(at)
        asked = [v for f, v in ask if f == name]
        per.append(F.when((text.isin(asked) if asked else F.lit(False)) | hidden, F.struct(F.lit(name).alias("field"), text.alias("value"))))
    counted = df.select(F.explode(F.array_compact(F.array(*per))).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in reach.items() for x in kv]), F.col("field"))
    more = counted.where((F.col("n") >= least) & F.col("value").isNotNull()).join(F.broadcast(out.select("field", "value")), ["field", "value"], "left_anti")
    return out.unionByName(more.select("field", "value", F.col("n").alias("lower"), F.col("n").alias("upper")))
