"""Best-fit packing through length patterns fitted by non-negative least squares (operator 9).

Documents become pieces of at most ``capacity`` tokens. All that the plan needs
of the corpus is how many pieces have each length: a histogram of ``capacity``
counts, whatever the number of documents. On it

1. patterns of few lengths that fill a sequence are enumerated over coarse bins,
2. non-negative least squares fits how often each pattern repeats,
3. the counts are rounded down and drawn from the exact lengths, and
4. what remains is packed best fit decreasing, by counts, into the gaps of those
   sequences and into new ones.

The plan says where the r-th piece of each length goes, so the pieces only need
their rank within their length. Ranks come from counts by task, never from a
sort of all pieces of a length.

Defined cases: null text is the empty string (the end id alone); rows that
repeat are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table, text_or_empty
from .tokenizing import default_file, encoder, with_end

CAPACITY = 4096
#: Coarse bins of a sequence, and the most documents in a pattern.
COARSE, MOST_IN_PATTERN = 64, 3
#: Shares of the fitted repeats that plans take; the rest is packed best fit.
SHARES = (1.0, 0.9, 0.6, 0.3)


def patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``most`` numbers that sum to ``units``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int, top: int):
        if not rest:
            out.append(head)
        elif len(head) < most:
            for x in range(min(top, rest), 0, -1):
                if x * (most - len(head)) < rest:
                    break
                extend((*head, x), rest - x, x)

    extend((), units, units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |ax - b|, x >= 0."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-9 * scale:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 1e-12 * scale)
            if not low.any():
                break
            if low[j] and x[j] == 0:  # the newest can't enter: numerically at the optimum
                free[j] = False
                return x
            step = float((x[low] / np.maximum(x[low] - s[low], 1e-300)).min())
            x += step * (s - x)
            free &= x > 1e-12 * scale
            x[~free] = 0
        x = s
    return x


def _draw(left: np.ndarray, pools: dict[int, list[int]], shape: tuple[int, ...], capacity: int) -> Counter | None:
    """Exact lengths for one sequence of a pattern, the longest of each bin; None if a bin is used up.

    The last piece is the longest that still fits, of any bin, so that rounding
    lengths up to bins leaves no gap.
    """
    drawn: Counter = Counter()
    for b in shape[:-1]:
        while pools[b] and not left[pools[b][-1]]:
            pools[b].pop()
        length = next((x for x in reversed(pools[b]) if left[x] > drawn[x]), None)
        if length is None:
            return None
        drawn[length] += 1
    gap = capacity - sum(length * q for length, q in drawn.items())
    there = left[: gap + 1] > 0
    for length, q in drawn.items():
        if length <= gap:
            there[length] = left[length] > q
    if not there.any():
        return None
    drawn[gap - int(there[::-1].argmax())] += 1
    return drawn


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, coarse: int = COARSE) -> dict[str, np.ndarray]:
    """The plan with the fewest sequences of those that round the fitted repeats down by several shares."""
    plans = (one_plan(histogram, capacity, coarse, most, share) for most in range(2, MOST_IN_PATTERN + 1) for share in SHARES)
    return min(plans, key=lambda p: int(p["sequences"][0]))


def one_plan(histogram: dict[int, int], capacity: int, coarse: int, most: int, share: float) -> dict[str, np.ndarray]:
    """Segments (length, first rank, first sequence, pieces of it a sequence, offset) from counts by length.

    Counts are placed, not pieces: a class is a number of sequences filled
    alike. A placement uses up a length, a class, or both, so the classes stay
    of the order of the distinct lengths, at most ``capacity`` of them.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] += count
    done: list[tuple[int, list]] = []  # (sequences, [(length, pieces a sequence)...])
    by_gap: dict[int, list] = defaultdict(list)

    def put(count: int, items: list):
        gap = capacity - sum(length * q for length, q in items)
        (by_gap[gap] if gap else done).append((count, items))

    if left[capacity]:
        put(int(left[capacity]), [(capacity, 1)])
        left[capacity] = 0
    width = -(-capacity // coarse)
    units = capacity // width
    pools: dict[int, list[int]] = defaultdict(list)
    for length in np.flatnonzero(left).tolist():
        pools[-(-length // width)].append(length)  # ascending: the longest of a bin is at its end
    coarse_counts = np.array([left[pools[b]].sum() if pools[b] else 0 for b in range(1, units + 1)], dtype=float)
    shapes = [p for p in patterns(units, most) if all(coarse_counts[b - 1] for b in p)]
    if shapes:
        a = np.zeros((units, len(shapes)))
        for k, shape in enumerate(shapes):
            for b in shape:
                a[b - 1, k] += 1
        # long pieces weigh more: short ones are filling that the residual step places well
        weight = np.sqrt(np.arange(1, units + 1) / units)[:, None]
        repeats = np.floor(share * nnls(a * weight, coarse_counts * weight[:, 0]) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable").tolist():
            todo = int(repeats[k])
            while todo > 0 and (drawn := _draw(left, pools, shapes[k], capacity)):
                times = min(todo, min(int(left[length]) // q for length, q in drawn.items()))
                for length, q in drawn.items():
                    left[length] -= q * times
                put(times, list(drawn.items()))
                todo -= times
    open_gaps = np.zeros(capacity + 1, dtype=bool)
    open_gaps[[g for g, v in by_gap.items() if v]] = True
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = int(open_gaps[length:].argmax()) + length
            if open_gaps[fits]:
                n, items = by_gap[fits].pop()
                open_gaps[fits] = bool(by_gap[fits])
            else:
                fits, items = capacity, []
                n = -(-count // (capacity // length))
            q = fits // length
            full = min(n, count // q)
            odd = count - full * q if full < n else 0
            for m, more in ((full, q), (1 if odd else 0, odd), (n - full - (1 if odd else 0), 0)):
                if m:
                    new = [*items, (length, more)] if more else items
                    gap = fits - length * more
                    if gap:
                        by_gap[gap].append((m, new))
                        open_gaps[gap] = True
                    else:
                        done.append((m, new))
            count -= full * q + odd
    rank, first, rows = defaultdict(int), 0, []
    for n, items in done + [c for g in sorted(by_gap) for c in by_gap[g]]:
        if not items:
            continue
        offset = 0
        for length, q in items:
            rows.append((length, rank[length], first, q, offset))
            rank[length] += n * q
            offset += length * q
        first += n
    rows.sort()
    names = ("length", "rank", "sequence", "times", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)} | {"sequences": np.array([first])}


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    key = plan["length"] * (1 << 48) + plan["rank"]
    at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
    nth = rank - plan["rank"][at]
    times = plan["times"][at]
    return plan["sequence"][at] + nth // times, plan["offset"][at] + nth % times * length


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, file: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encoded and cut documents; ``nth`` counts a task's pieces of equal length. Stored, so that both stay as they are."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, counts = with_end(*encoder(file, False, "<u4").encode(batch.column(1)), end_id)
            many = -(-counts // capacity)  # pieces of each document
            of = np.repeat(np.arange(len(counts)), many)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(counts[of] - start, capacity)
            ends = np.cumsum(length)
            order = np.argsort(length, kind="stable")
            nth = np.empty(len(of), dtype=np.int64)
            by_length = np.bincount(length, minlength=capacity + 1)
            nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(by_length) - by_length, by_length)
            nth += seen[length]
            seen += by_length
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(np.full(len(of), task), pa.int32()), pa.array(nth)]
            if with_ids:
                columns.append(pa.array([bytes(x) for x in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(cut, schema), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of :func:`pieces`."""
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = make_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "task")

    def where(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sequence, offset = place(plan, t["length"].to_numpy().astype(np.int64), t["rank"].to_numpy())
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.to_batches()

    kept = ranked.drop("rank")
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*kept.columns, "rank").mapInArrow(where, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, ids (binary), and where each document starts."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return out.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("documents"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(pieces(table(spark, sf_dir, "documents"), default_file("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
