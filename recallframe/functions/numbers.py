"""Numeric projections: coercions, intervals, byte models and block arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c

# Fixed values.
Z = 1.96
MIB = 1024 * 1024


def number(x: ColumnOrName) -> Column:
    """A number from a text; null where it is none. Booleans are no numbers."""
    t = F.trim(_c(x).cast("string"))
    return F.when(F.lower(t).isin("true", "false"), F.lit(None)).otherwise(t.try_cast("double"))


def safe_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def per_second(count: ColumnOrName, total_ms: ColumnOrName) -> Column:
    return F.when((_c(count) != 0) & (_c(total_ms) > 0), _c(count) / (_c(total_ms) / 1000))


def wilson(correct: ColumnOrName, total: ColumnOrName, z: float = Z) -> Column:
    """Score interval of a share, within 0 and 1; (0, 0) without observations."""
    n, k = _c(total).cast("double"), _c(correct).cast("double")
    p = k / n
    scale = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    reach = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    empty = n <= 0
    return F.struct(F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), mid - reach)).alias("lower"), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), mid + reach)).alias("upper"))


def overlap_ratio(latency: ColumnOrName, stall: ColumnOrName) -> Column:
    """Share of a transfer that ran beside other work."""
    return F.when(_c(latency) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(stall) / _c(latency))))


def mebibytes(n: ColumnOrName) -> Column:
    return _c(n) / F.lit(MIB)


def graph_bytes(vectors: ColumnOrName, dim: ColumnOrName, neighbours: ColumnOrName, width: int = 2) -> Column:
    """Bytes of a serialised proximity graph: a header, then vector, degree and neighbour ids of each node."""
    return 32 + _c(vectors) * (_c(dim) * width + 1 + _c(neighbours) * 4)


def align_down(n: ColumnOrName, block: ColumnOrName | int) -> Column:
    b = F.lit(block) if isinstance(block, int) else _c(block)
    return _c(n) - _c(n) % b


def slot_mapping(blocks: ColumnOrName, block_size: int, tokens: ColumnOrName) -> Column:
    """Slots of the first ``tokens`` tokens in paged blocks; raises where the blocks hold fewer."""
    slots = F.flatten(F.transform(_c(blocks), lambda b: F.sequence(b * block_size, b * block_size + block_size - 1)))
    short = F.size(_c(blocks)) * block_size < _c(tokens)
    return F.when(short, F.raise_error(F.lit("blocks hold fewer tokens")).cast("array<int>")).otherwise(F.slice(slots, F.lit(1), _c(tokens)))


def positive_delta(before: ColumnOrName, after: ColumnOrName) -> Column:
    return F.when(_c(before).isNotNull() & _c(after).isNotNull(), F.greatest(F.lit(0), _c(after) - _c(before)))


def sum_of_present(*xs: ColumnOrName) -> Column:
    total: Column = F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(_c(x).cast("double"), F.lit(0.0))
    return total


def time_to_first_token(latency_s: ColumnOrName, first: ColumnOrName, arrival: ColumnOrName) -> Column:
    """Milliseconds: a positive latency, else a non-negative difference; raises without either."""
    gap = _c(first) - _c(arrival)
    return F.when(_c(latency_s) > 0, _c(latency_s) * 1000).when(gap >= 0, gap * 1000).otherwise(F.raise_error(F.lit("no first-token timing")).cast("double"))


def fixed(x: ColumnOrName, digits: int, suffix: str = "") -> Column:
    """A number with so many decimals; a half goes to the even digit."""
    return F.format_string(f"%.{digits}f{suffix}", F.bround(_c(x).cast("double"), digits))


def two_digits(x: ColumnOrName, suffix: str = "") -> Column:
    return F.when(_c(x).isNull(), "-").otherwise(fixed(x, 2, suffix))


def ratio_text(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.when(_c(a).isNull() | _c(b).isNull() | (_c(b) <= 0), "-").otherwise(fixed(_c(a) / _c(b), 2, "x"))


def result_columns(users: ColumnOrName, per_user: int, generation_s: ColumnOrName, tokens_in: ColumnOrName, tokens_out: ColumnOrName) -> dict[str, Column]:
    """Requests, throughput, latency and token rates of a measured batch; raises without measured time."""
    seconds = F.when(_c(generation_s) > 0, _c(generation_s)).otherwise(F.raise_error(F.lit("no measured time")).cast("double"))
    requests = (_c(users) * per_user).cast("long")
    return {
        "total_requests": requests,
        "throughput_qps": requests / seconds,
        "avg_latency_ms": seconds / requests * 1000,
        "input_tokens_per_second": _c(tokens_in) / seconds,
        "output_tokens_per_second": _c(tokens_out) / seconds,
    }
