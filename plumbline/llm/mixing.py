"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that name them). The flow sends each pattern's words
to its sources: a pattern passes its own size once at cost 0 and each further repetition at a higher cost (convex), a
source takes up to its quota. The flow fixes how many words of each pattern are taken; documents of a pattern are
then chosen in a seeded order, whole, once or repeatedly, until the number is reached, and the last gap is closed by
the documents that come nearest to it.

Patterns and sources are configuration (tens to thousands), so their totals are what the driver solves over; the
documents themselves are only summed, by pattern and by range of the seeded order.

Defined cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are taken 0
words; equal hashes in the seeded order are told apart by doc_id and a row number; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, landed, n_words, nested

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 20240501
#: The seeded order is summed by 2 to this power ranges in each pattern.
RANGE_BITS = 12
#: Rounds of closing the gap.
FILLS = 3


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = REPEATS) -> dict:
    """Words that each source is to give: weights repeat over the sources by code point, null last; none above ``most``
    times its size, what is above being shared anew by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = Fraction(share) * sum(sizes.values())
    result: dict = {}
    free = list(order)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > Fraction(most * sizes[s]) * total]
        if not above:
            result |= {s: float(left * weight[s] / total) for s in free}
            break
        for s in above:
            result[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        free = [s for s in free if s not in above]
    return result


def route(sizes: dict[str, int], members: dict[str, tuple], quotas: dict, repeats: int = REPEATS) -> dict[str, int]:
    """Words to take of each pattern: a maximal flow of least repetition cost.

    Successive shortest paths with potentials over source -> pattern -> sources -> sink; the r-th repetition of a
    pattern is an edge of the pattern's size and of cost r.
    """
    names = list(sizes)
    sources = list(quotas)
    count = 2 + len(names) + len(sources)
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(count)]
    to, capacity, cost = [], [], []

    def edge(a: int, b: int, c: int, price: int) -> None:
        for x, y, cap, p in ((a, b, c, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            capacity.append(cap)
            cost.append(p)

    for i, name in enumerate(names):
        for r in range(repeats):
            edge(0, 2 + i, sizes[name], r)
    for i, name in enumerate(names):
        for s in members[name]:
            edge(2 + i, at[s], repeats * sizes[name], 0)
    for s in sources:
        edge(at[s], 1, int(round(quotas[s])), 0)
    potential = [0] * count
    while True:
        distance = [None] * count
        distance[0], via, queue = 0, [-1] * count, [(0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > distance[x]:
                continue
            for e in graph[x]:
                if capacity[e] > 0:
                    new = d + cost[e] + potential[x] - potential[to[e]]
                    if distance[to[e]] is None or new < distance[to[e]]:
                        distance[to[e]], via[to[e]] = new, e
                        heapq.heappush(queue, (new, to[e]))
        if distance[1] is None:
            break
        potential = [p + d if d is not None else p for p, d in zip(potential, distance)]
        path, x = [], 1
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(capacity[e] for e in path)
        for e in path:
            capacity[e] -= push
            capacity[e ^ 1] += push
    first = 0
    flows = {}
    for name in names:
        flows[name] = sum(capacity[first + 2 * r + 1] for r in range(repeats))
        first += 2 * repeats
    return flows


def marked(docs: DataFrame, members: Column, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The documents with the key of their pattern and their place in the seeded order (``__row`` parts equal rows)."""
    pattern = F.array_sort(F.array_distinct(members))
    return docs.withColumns({
        "__pattern": pattern,
        "__k": F.to_json(pattern, {"ignoreNullFields": "false"}),
        "__place": F.xxhash64(F.lit(seed), column(doc_id), column(text)),
        "__row": F.monotonically_increasing_id(),
    })


class Mixture(NamedTuple):
    """Words in all and words wanted by source, and one row per pattern that says which of its documents are taken."""

    totals: dict
    quotas: dict
    rules: DataFrame


def plan_mixture(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> Mixture:
    """The rules for landed rows (__pattern, __k, __place, __row, size)."""
    spark = sized.sparkSession
    patterns = {
        r["__k"]: (tuple(r["__pattern"]), r["n"])
        for r in sized.groupBy("__k", "__pattern").agg(F.sum("size").alias("n")).collect()
    }
    totals: dict = {}
    for name, n in patterns.values():
        for s in name:
            totals[s] = totals.get(s, 0) + n
    quotas = targets(totals, weights, share)
    flows = route({k: n for k, (_, n) in patterns.items()}, {k: name for k, (name, _) in patterns.items()}, quotas)
    base = {k: min(flows[k] // n, REPEATS) if n else 0 for k, (_, n) in patterns.items()}
    wanted = {k: flows[k] - base[k] * n for k, (_, n) in patterns.items()}

    # the range of the order in which the wanted number is reached, and what the ranges before it hold
    position = F.shiftrightunsigned("__place", 64 - RANGE_BITS)
    placed = sized.withColumn("range", position)
    limits = F.broadcast(spark.createDataFrame(sorted(wanted.items()), "__k string, wanted long"))
    before = Window.partitionBy("__k").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("__k", "range").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(before))
    cuts = sums.join(limits, "__k").filter((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("n") <= F.col("wanted")))
    cut = {r["__k"]: (r["range"], r["upto"] - r["n"]) for r in cuts.collect()}
    starts = spark.createDataFrame([(k, *cut[k], wanted[k]) for k in cut], "__k string, range long, before long, wanted long")
    running = Window.partitionBy("__k").orderBy("__place", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.join(F.broadcast(starts), ["__k", "range"]).withColumn("reached", F.col("before") + F.sum("size").over(running))
    last = inside.filter("reached <= wanted").groupBy("__k").agg(F.max(F.struct("reached", "__place", "__row")).alias("last"))
    last = {r["__k"]: r["last"] for r in last.collect()}
    gaps = {k: wanted[k] - (last[k]["reached"] if k in last else before) for k, (_, before) in cut.items()}

    # the gap is filled with the documents whose size comes nearest to it
    fills: dict[str, list] = {k: [] for k in patterns}

    def rules() -> DataFrame:
        return spark.createDataFrame([
            (k, base[k], wanted[k] > 0, cut[k][0] if k in cut else 1 << RANGE_BITS,
             last[k]["__place"] if k in last else None, last[k]["__row"] if k in last else None, fills[k])
            for k in sorted(patterns)
        ], RULE)

    for _ in range(FILLS):
        open_gaps = [(k, g) for k, g in gaps.items() if g > 0]
        if not open_gaps:
            break
        small = F.broadcast(spark.createDataFrame(open_gaps, "__k string, gap long"))
        free = placed.join(small, "__k").filter("size > 0 and size < 2 * gap").join(F.broadcast(rules()), "__k")
        nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "__place", "__row", "size")).alias("best")
        best = free.filter(~_once_more()).groupBy("__k").agg(nearest).collect()
        if not best:
            break
        for r in best:
            fills[r["__k"]].append((r["best"]["__place"], r["best"]["__row"]))
            gaps[r["__k"]] -= r["best"]["size"]
    return Mixture(totals, quotas, rules())


RULE = (
    "__k string, __base long, __partial boolean, __cut long, __last_place long, __last_row long, "
    "__fills array<struct<__place: bigint, __row: bigint>>"
)


def _once_more() -> Column:
    """Whether a document belongs to the partial repetition of its pattern."""
    position = F.shiftrightunsigned("__place", 64 - RANGE_BITS)
    upto = (F.col("__place") < F.col("__last_place")) | (
        (F.col("__place") == F.col("__last_place")) & (F.col("__row") <= F.col("__last_row")))
    ordered = (position < F.col("__cut")) | ((position == F.col("__cut")) & F.coalesce(upto, F.lit(False)))
    filled = F.array_contains("__fills", F.struct("__place", "__row"))
    return F.col("__partial") & (ordered | filled)


def times_taken(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """``rows`` (of ``marked``) with ``__times``: how often the mix takes each document."""
    ruled = rows.join(F.broadcast(mixture.rules), "__k")
    return ruled.withColumn("__times", F.col("__base") + _once_more().cast("long"))


def sized(rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What planning needs of ``rows`` (of ``marked``), landed."""
    return landed(rows.select(
        column(doc_id).cast("long").alias("doc_id"), "__pattern", "__k", "__place", "__row", n_words(column(text)).alias("size")), "sized")


def mix_documents(docs: DataFrame, members: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents as the mix takes them: absent, once or repeatedly; columns as given."""
    given = docs.select(
        nested(docs), column(doc_id).alias("doc_id"), column(text).alias("text"), members.alias("members"))
    rows = marked(given, F.col("members"))
    taken = times_taken(rows, plan_mixture(sized(rows)))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))
    return taken.withColumn("__copy", copies).select("doc.*")
