"""Filling containers: variable-capacity best fit over the histogram of sizes, then every item sent to its place.

Items of one size are alike, so best fit decreasing is run on (size, count) pairs, of which there are at most as many as
the largest capacity, whatever the number of items.  Its outcome is a short list of runs: "items a .. a+m of size s go to
containers b .. , q to each".  Items get their rank within their size by salted counting, so a size with a third of all
rows is spread over many tasks, and find their container by an equi-join with the runs, block of ranks by block of ranks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.sources.tables import checkpointed

#: Items of one size that one task ranks; the number of salts follows from it and from the largest count.
RANKED_AT_ONCE = 100_000
#: Ranks, and containers, that one row of the lists of runs and of containers covers in the joins.
BLOCK = 1 << 16
#: Rows up to which these lists are broadcast; beyond it the joins shuffle.
BROADCAST_RUNS = 200_000


class Run(NamedTuple):
    """``count`` items of ``size`` from rank ``first`` on go to containers from ``container`` on, ``each`` to one."""

    size: int
    first: int
    count: int
    container: int
    each: int


class Span(NamedTuple):
    """Containers ``start`` .. ``start + count - 1`` with the same capacity and free space."""

    start: int
    count: int
    capacity: int


class Box(NamedTuple):
    """Containers ``start`` .. ``start + count - 1`` of one capacity with the same contents."""

    start: int
    count: int
    capacity: int
    used: int


class Plan(NamedTuple):
    """The runs, and the containers."""

    runs: list[Run]
    containers: list[Box]


def _unfilled(capacity: int, size: int, sizes: list[int], count: dict[int, int]) -> int:
    """What would stay unused in a container of this capacity opened for items of ``size``, filled greedily with the items that are left."""
    space, k = capacity, bisect_right(sizes, size) - 1
    while k >= 0 and space:
        n = min(count[sizes[k]], space // sizes[k])
        space -= n * sizes[k]
        k = min(k - 1, bisect_right(sizes, space) - 1)
    return space


def _fill(histogram: Sequence[tuple[int, int]], capacities: list[int]) -> Plan:
    """Best fit decreasing on (size, count) pairs with several capacities, each container cut down to its contents."""
    free: dict[int, list[Span]] = {}
    spaces: list[int] = []  # the keys of free, ascending
    runs: list[Run] = []
    opened = 0
    count = {s: n for s, n in histogram if n > 0}
    sizes = sorted(count)
    rest_tokens = sum(s * n for s, n in count.items())

    def put(space: int, span: Span) -> None:
        if space not in free:
            free[space] = []
            insort(spaces, space)
        free[space].append(span)

    while sizes:
        size, total = sizes[-1], count[sizes[-1]]
        rank = 0
        while rank < total:
            left = total - rank
            count[size] = left
            k = bisect_left(spaces, size)
            if k < len(spaces):
                space = spaces[k]
                span = free[space].pop()
                if not free[space]:
                    del free[space], spaces[k]
            else:
                space = min((c for c in capacities if c >= size), key=lambda c: (_unfilled(c, size, sizes, count) / c, -c))
                need = -(-left // (space // size))
                span = Span(opened, min(need, max(1, (rest_tokens - size * rank) // space)), space)  # the choice holds while there is enough to fill them
                opened += span.count
            each = space // size
            full = min(span.count, left // each)
            if full:
                runs.append(Run(size, rank, full * each, span.start, each))
                put(space - each * size, Span(span.start, full, span.capacity))
                rank += full * each
            rest = span.count - full
            if rest and rank < total and full == left // each:  # the last, partly filled container
                some = total - rank
                runs.append(Run(size, rank, some, span.start + full, each))
                put(space - some * size, Span(span.start + full, 1, span.capacity))
                rank, full, rest = total, full + 1, rest - 1
            if rest:
                put(space, Span(span.start + full, rest, span.capacity))
        rest_tokens -= size * total
        sizes.pop()
    boxes = []
    for space, spans in free.items():
        for start, n, capacity in spans:
            used = capacity - space
            boxes.append(Box(start, n, next(c for c in capacities if c >= used), used))
    return Plan(runs, sorted(boxes))


def _cut(runs: list[Run], boxes: list[Box]) -> dict[int, list[Run]]:
    """Each box's runs, with containers counted from the box's start; runs are cut where a box ends."""
    starts = [b.start for b in boxes]
    out: dict[int, list[Run]] = {k: [] for k in range(len(boxes))}
    for r in runs:
        at, end = r.container, r.container - (-r.count // r.each)
        k = bisect_right(starts, at) - 1
        while at < end:
            stop = min(end, boxes[k].start + boxes[k].count)
            first = (at - r.container) * r.each
            out[k].append(Run(r.size, r.first + first, min(r.count, (stop - r.container) * r.each) - first, at - boxes[k].start, r.each))
            at, k = stop, k + 1
    return out


def best_fit(histogram: Sequence[tuple[int, int]], capacities: Sequence[int]) -> Plan:
    """Variable-capacity best fit on (size, count) pairs; sizes are 1 .. max(capacities).

    An item goes to the open container with the least free space that holds it.  If none does, a container is opened
    whose capacity costs least: the one of which the smallest share would stay unused when filled with the items that are
    left, of equal ones the largest.  At the end each container is replaced by the smallest permitted one that holds its
    contents; the contents of containers in which still as much is unused as the smallest capacity are packed anew, if
    that takes less room.  With one capacity this is best fit decreasing.
    """
    allowed = sorted({c for c in capacities if c > 0})
    plan = _fill(histogram, allowed)
    loose = [k for k, b in enumerate(plan.containers) if b.capacity - b.used >= allowed[0]] if len(allowed) > 1 else []
    if not loose:
        return plan
    inside = _cut(plan.runs, plan.containers)
    pool: dict[int, list[Run]] = {}
    for k in loose:
        for r in inside[k]:
            pool.setdefault(r.size, []).append(r)
    again = _fill([(size, sum(r.count for r in rs)) for size, rs in pool.items()], [c for c in allowed if c < allowed[-1]] if max(pool) <= allowed[-2] else allowed)
    if sum(b.count * b.capacity for b in again.containers) >= sum(plan.containers[k].count * plan.containers[k].capacity for k in loose):
        return plan
    runs: list[Run] = []
    boxes: list[Box] = []
    at = 0
    for k, b in enumerate(plan.containers):
        if k not in set(loose):
            runs += [r._replace(container=at + r.container) for r in inside[k]]
            boxes.append(b._replace(start=at))
            at += b.count
    for r in again.runs:  # ranks within the pool back to ranks of all items of the size
        skip, done = r.first, 0
        for p in pool[r.size]:
            if skip >= p.count:
                skip -= p.count
                continue
            while skip < p.count and done < r.count:  # pieces that begin within a container are runs of their own
                some = min(p.count - skip, r.count - done, r.each - done % r.each if done % r.each else r.count)
                runs.append(Run(r.size, p.first + skip, some, at + r.container + done // r.each, r.each))
                skip, done = skip + some, done + some
            skip = 0
    return Plan(runs, boxes + [b._replace(start=at + b.start) for b in again.containers])


def _ranked(items: DataFrame, by: list[str], order: list[str], salts: int) -> DataFrame:
    """``rank``: 0-based place of each row among the rows of its ``by`` values, counted salt by salt."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*by, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(*by, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    numbered = salted.withColumn("_k", within)
    return numbered.join(offsets, [*by, "_salt"]).withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_salt", "_k", "_before")


def pack(sizes: DataFrame, key: str, size: str, packings: dict[str, dict[str, int]]) -> DataFrame:
    """Every item of every packing with its container.

    ``packings`` names the permitted capacities of each packing, by capacity code: one code packs into containers of that
    capacity, several are optimised jointly.  Result: packing, capacity_code, capacity_tokens, container_id, key, piece,
    token_from, tokens.  An item longer than the largest capacity is cut into pieces of that capacity and a rest; no other
    item is split.  Items of size 0 (null and empty texts) take no space and are dealt over the containers in turn
    (container 0 of the smallest capacity if there is none).  Equal keys are different items.  No items give no rows.
    """
    spark = sizes.sparkSession
    items = checkpointed(sizes.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size")))
    limits = F.array(*(F.struct(F.lit(name).alias("packing"), F.lit(max(c.values())).cast("bigint").alias("_most")) for name, c in packings.items()))
    per = items.select(key, "_size", F.explode(limits).alias("_p")).select(key, "_size", "_p.packing", "_p._most")
    last = F.when(F.col("_size") == 0, 0).otherwise(F.expr("(_size - 1) div _most"))
    pieces = per.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int")))).select(
        "packing", key, "piece", (F.col("piece") * F.col("_most")).alias("token_from"), F.least(F.col("_most"), F.col("_size") - F.col("piece") * F.col("_most")).alias("tokens")
    )
    counted = pieces.groupBy("packing", "tokens").agg(F.count("*").alias("n")).collect()  # at most packings x largest capacity rows
    run_rows, container_rows, totals = [], [], {}
    for name, capacities in packings.items():
        codes = {c: code for code, c in sorted(capacities.items(), reverse=True)}
        plan = best_fit([(r["tokens"], r["n"]) for r in counted if r["packing"] == name and r["tokens"] > 0], list(capacities.values()))
        total = sum(n for _, n, _, _ in plan.containers)
        totals[name] = max(1, total)
        run_rows += [(name, *r) for r in plan.runs]
        container_rows += [(name, a, a + n, codes[c], c, used) for a, n, c, used in plan.containers]
        if not total:
            least = min(capacities.values())
            container_rows.append((name, 0, 1, codes[least], least, 0))
    runs = spark.createDataFrame(run_rows, "packing string, tokens bigint, first bigint, count bigint, container bigint, each bigint")
    boxes = spark.createDataFrame(container_rows, "packing string, box_from bigint, box_to bigint, capacity_code string, capacity_tokens int, used bigint")
    # ranks and containers are looked up by blocks, so that the range tests run within equi-joins that no size can make hot
    runs = runs.withColumn("_block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + count - 1) div {BLOCK}"))))
    boxes = boxes.withColumn("_block", F.explode(F.sequence(F.expr(f"box_from div {BLOCK}"), F.expr(f"(box_to - 1) div {BLOCK}"))))
    most = max((r["n"] for r in counted), default=1)
    if len(run_rows) + len(container_rows) + (most * len(packings) + sum(totals.values())) // BLOCK <= BROADCAST_RUNS:
        runs, boxes = F.broadcast(runs), F.broadcast(boxes)
    ranked = _ranked(pieces, ["packing", "tokens"], [key, "piece"], -(-most // RANKED_AT_ONCE))
    in_run = (F.col("r.packing") == F.col("i.packing")) & (F.col("r.tokens") == F.col("i.tokens")) & (F.col("r._block") == F.expr(f"i.rank div {BLOCK}")) & (F.col("i.rank") >= F.col("r.first")) & (F.col("i.rank") < F.col("r.first") + F.col("r.count"))
    placed = ranked.where("tokens > 0").alias("i").join(runs.alias("r"), in_run).select("i.packing", f"i.{key}", "i.piece", "i.token_from", "i.tokens", F.expr("r.container + (i.rank - r.first) div r.each").alias("container_id"))
    number = F.element_at(F.create_map(*(F.lit(x) for pair in totals.items() for x in pair)), F.col("packing"))
    empty = ranked.where("tokens = 0").select("packing", key, "piece", "token_from", "tokens", (F.col("rank") % number).alias("container_id"))
    every = placed.unionByName(empty).alias("i")
    in_box = (F.col("b.packing") == F.col("i.packing")) & (F.col("b._block") == F.expr(f"i.container_id div {BLOCK}")) & (F.col("i.container_id") >= F.col("b.box_from")) & (F.col("i.container_id") < F.col("b.box_to"))
    return every.join(boxes.alias("b"), in_box).select("i.packing", "b.capacity_code", "b.capacity_tokens", "i.container_id", f"i.{key}", "i.piece", "i.token_from", "i.tokens")


def containers(packed: DataFrame) -> DataFrame:
    """(packing, capacity_code, capacity_tokens, container_id, items, used): one row per container."""
    return packed.groupBy("packing", "capacity_code", "capacity_tokens", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))


def waste(boxes: DataFrame) -> DataFrame:
    """(packing, capacity_code, capacity_tokens, containers, used, unused): the room that each packing takes, by capacity."""
    by = ["packing", "capacity_code", "capacity_tokens"]
    return boxes.groupBy(*by).agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum(F.col("capacity_tokens") - F.col("used")).alias("unused"))
