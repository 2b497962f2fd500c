"""Lines of interval (BED) files: valid entries and, apart, each bad line with its reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines parsed at once on the fast path; a failing block is bisected.
BLOCK_LINES = 512

#: The twelve columns of a BED line, in order.
COLUMNS = (
    "container_name", "chrom_start", "chrom_end", "feature_name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts",
)
#: Columns that must hold a whole number within 32 bits, in the order in which they are blamed.
NUMBERS = (1, 2, 4, 6, 7)
_LOW, _HIGH = -(2**31), 2**31 - 1
_NUMBER = re.compile(r"[+-]?[0-9]+", re.ASCII)
_GAP = re.compile(r"\t| +")

OUT = "kind string, reason string, " + ", ".join(f"{c} {'int' if i in NUMBERS else 'string'}" for i, c in enumerate(COLUMNS))


def split_line(line: str) -> list[str]:
    """The columns of one line: separated by a single tab or a run of spaces, outside double quotes."""
    if '"' not in line:
        return _GAP.split(line)
    cells, held, at = [], [], 0
    while at < len(line):
        ch = line[at]
        if ch == '"':
            end = line.find('"', at + 1)
            end = len(line) if end < 0 else end + 1
            held.append(line[at:end])
            at = end
        elif ch == "\t" or ch == " ":
            cells.append("".join(held))
            held = []
            at += 1
            while ch == " " and at < len(line) and line[at] == " ":
                at += 1
        else:
            held.append(ch)
            at += 1
    cells.append("".join(held))
    return cells


def _number(cell: str) -> int | None:
    if not _NUMBER.fullmatch(cell):
        return None
    digits = cell.lstrip("+-").lstrip("0")
    if len(digits) > 10:
        return None
    v = int(cell)
    return v if _LOW <= v <= _HIGH else None


def diagnose(line: str | None) -> tuple[str, str | None, list]:
    """Kind ('entry', 'skipped', 'track', 'bad'), reason and the twelve cells of one line, strictly.

    The line comes without its carriage return. A null line has no columns: it is bad for 'columns', as an
    empty one is.
    """
    none = [None] * len(COLUMNS)
    line = line or ""
    if line.startswith("#") or line.startswith("browser"):
        return "skipped", None, none
    if line.count('"') % 2:
        return "bad", "quoting", none
    if line.startswith("track"):
        return "track", None, none
    cells = split_line(line)
    if not line or not 3 <= len(cells) <= len(COLUMNS):
        return "bad", "columns", none
    row: list = [*cells, *none[len(cells) :]]
    for i in NUMBERS:
        if i < len(cells):
            if i == 4 and cells[i] in ("", "."):
                row[i] = None
                continue
            row[i] = _number(cells[i])
            if row[i] is None:
                return "bad", COLUMNS[i], none
    return "entry", None, row


class Cells:
    """A batch of lines cut into cells at once, of which blocks of lines can be parsed.

    A line is plain if it has no header mark, no separator within quotes and 3 to 12 columns; the numbers of all
    plain lines stand in one array, in order, so that a block's numbers are one slice of it.
    """

    def __init__(self, lines: pa.Array):
        n = len(lines)
        # Header lines, a separator within quotes, or an odd number of quotes: left to the strict path.
        odd = pc.match_substring_regex(lines, r'^(#|browser|track)|"[^"]*[\t ][^"]*"|^[^"]*("[^"]*"[^"]*)*"[^"]*$')
        cells = pc.split_pattern(pc.replace_substring_regex(lines, " +", "\t"), "\t")
        width = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
        self.plain = ~pc.fill_null(odd, True).to_numpy(zero_copy_only=False) & (width >= 3) & (width <= len(COLUMNS))
        self.width, self.first = width, np.concatenate(([0], np.cumsum(width)[:-1])).astype("int64")
        self.flat = cells.flatten()
        # Rows of numbers: which cells of each plain line must be one, line by line.
        column = np.array(NUMBERS)
        there = self.plain[:, None] & (column[None, :] < width[:, None])
        at = (self.first[:, None] + column[None, :])[there]
        text = self.flat.take(pa.array(at))
        blank = pc.is_in(text, pa.array(["", "."])).to_numpy(zero_copy_only=False) & (np.broadcast_to(column, there.shape)[there] == 4)
        there[there] = ~blank
        text = text.filter(pa.array(~blank))
        # One sign goes before the cast, which knows no '+' and would take hexadecimal numbers.
        self.numbers = pc.replace_substring_regex(pc.replace_substring_regex(text, r"^\+([0-9])", r"\1"), r"^-?0[xX]", "!")
        self.upto = np.concatenate(([0], np.cumsum(there.sum(1))))
        self.there, self.n = there, n

    def parse(self, rows: np.ndarray) -> pa.Array:
        """The numbers of neighbouring plain lines as 32-bit integers; raises ArrowInvalid if one of them has another cell there."""
        first, last = self.upto[rows[0]], self.upto[rows[-1] + 1]
        return self.numbers.slice(first, last - first).cast(pa.int32())

    def columns(self, rows: np.ndarray, values: np.ndarray) -> list[pa.Array]:
        """The twelve columns of parsed lines; `values`: their numbers, in order."""
        numbers = np.zeros((len(rows), len(NUMBERS)), "int32")
        numbers[self.there[rows]] = values
        out = []
        for i in range(len(COLUMNS)):
            if i in NUMBERS:
                k = NUMBERS.index(i)
                out.append(pa.array(numbers[:, k], mask=~self.there[rows, k]))
            else:
                have = self.width[rows] > i
                out.append(self.flat.take(pa.array(np.where(have, self.first[rows] + i, 0), mask=~have)))
        return out


def resolve(cells: Cells, block: int) -> tuple[list[tuple[np.ndarray, pa.Array]], np.ndarray]:
    """(lines, numbers) of each block that parses, and the lines for the strict path: those not plain, and those that stop a block.

    Blocks are of plain lines only. A failing one is bisected down to single lines; the next one is half as long then, and
    twice as long, up to `block`, after one that parsed.
    """
    plain = np.flatnonzero(cells.plain)
    good: list[tuple[np.ndarray, pa.Array]] = []
    bad = [np.flatnonzero(~cells.plain)]
    at, size = 0, block
    while at < len(plain):
        stack = [plain[at : at + size]]
        at += size
        whole = True
        while stack:
            rows = stack.pop()
            try:
                good.append((rows, cells.parse(rows)))
            except pa.ArrowInvalid:
                whole = False
                if len(rows) == 1:
                    bad.append(rows)
                else:
                    m = len(rows) // 2
                    stack += [rows[m:], rows[:m]]
        size = min(block, 2 * size) if whole else max(1, size // 2)
    return good, np.concatenate(bad)


def _parse(block: int, keep: int):
    """mapInArrow: batches whose last column is the line -> the other columns with the parse beside them."""
    types = [pa.int32() if i in NUMBERS else pa.string() for i in range(len(COLUMNS))]
    names = ["kind", "reason", *COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lines = b.column(keep).cast(pa.string())
            lines = pc.replace_substring_regex(lines, "\r\\z", "")
            cells = Cells(lines)
            good, isolated = resolve(cells, block)
            rows = np.concatenate([x for x, _ in good]) if good else np.zeros(0, "int64")
            values = np.concatenate([v.to_numpy(zero_copy_only=False) for _, v in good]) if good else np.zeros(0, "int32")
            strict = [diagnose(t) for t in lines.take(pa.array(isolated)).to_pylist()]
            columns = [
                pa.array(["entry"] * len(rows) + [d[0] for d in strict], pa.string()), pa.array([None] * len(rows) + [d[1] for d in strict], pa.string()),
                *[pa.concat_arrays([c.cast(t), pa.array([d[2][i] for d in strict], t)]) for i, (c, t) in enumerate(zip(cells.columns(rows, values), types, strict=True))],
            ]
            order = pa.array(np.concatenate([rows, isolated]))
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(order) for i in range(keep)], *columns], names=[*b.schema.names[:keep], *names])

    return run


def parse_lines(df: DataFrame, line: str, keep: list[str], *, block: int = BLOCK_LINES) -> DataFrame:
    """Each line with its kind, the reason if it is bad, and its twelve typed columns if it is an entry.

    Columns: `keep`, then kind ('entry', 'track', 'skipped', 'bad'), reason, container_name ... block_starts.
    Lines are cut into cells a batch at a time, and blocks of lines parsed at once: one cast of all their numbers.
    A block that doesn't parse is halved until the lines that stop it are alone. These, and lines that have no
    plain cells to parse, are diagnosed strictly, one by one. There is no shuffle, and a task holds one Arrow batch at a
    time.

    Rules: a carriage return at the end is no part of the line. Lines starting with '#' or 'browser' are
    'skipped'; lines starting with 'track' are bad only for an odd number of quotes. Reasons, the first that
    applies: 'quoting', 'columns' (fewer than 3 or more than 12, empty and null lines too), 'chrom_start',
    'chrom_end', 'score', 'thick_start', 'thick_end'. A score may be empty or '.', and is then null.

    Every input row gives exactly one row, so repeated rows stay repeated, and an empty table gives an empty
    result. Nulls in kept columns stay. Kept columns must not be named like the result's own.
    """
    own = {"kind", "reason", *COLUMNS}
    if own & set(keep):
        raise ValueError(f"column names taken by the result: {sorted(own & set(keep))}")
    if block < 1:
        raise ValueError("block must be at least 1")
    lines = df.select(*keep, F.col(line).alias("line_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields[:-1])
    return lines.mapInArrow(_parse(block, len(keep)), f"{schema}, {OUT}")


def bad_lines(df: DataFrame, line: str, keep: list[str], **options) -> DataFrame:
    """The bad lines only: `keep` and reason; see `parse_lines`."""
    return parse_lines(df, line, keep, **options).where("kind = 'bad'").select(*keep, "reason")


def valid_entries(df: DataFrame, line: str, keep: list[str], **options) -> DataFrame:
    """The entries only: `keep` and the twelve columns; see `parse_lines`."""
    return parse_lines(df, line, keep, **options).where("kind = 'entry'").drop("kind", "reason")
