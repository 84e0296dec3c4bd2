"""Walks over adjacency DataFrames (src, dst): depth windows, closures, shortest routes, simple paths, components.

Depth drives a loop on the driver; each level is a join of the frontier with the adjacency. Frontiers and results stay
distributed; between levels only "is there more" comes back, and lineage is cut every few levels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ROWS_PER_SALT, hot_keys, materialize, salted_join

#: Levels that are planned together before the loop looks whether there is more.
LEVELS_AT_ONCE = 3
#: Deltas that a closure keeps apart before it writes them together.
DELTAS = 6
#: A closure may double its distances from this depth on, if that makes at most so many times the known pairs.
DOUBLE_FROM, DOUBLE_COST = 4, 4
#: Nodes whose pairs (all that reach one with all that it reaches) are counted and not made. The sets of them are compared with
#: each other, 2 ** HUBS of either kind at most.
HUBS = 8
#: Longs in a row of the bit sets of ``compose``, a power of two, and how many times fewer rows than ways there must be for them.
WORDS, DENSE = 16, 8


class Steps:
    """An adjacency that many levels join with: its sources with very many edges are found once, and split in every join."""

    def __init__(self, adjacency: DataFrame, rows_per_salt: int = ROWS_PER_SALT):
        self.df, self.rows_per_salt = materialize(adjacency), rows_per_salt
        self.hot = hot_keys(self.df, ["src"], rows_per_salt)

    def ahead(self, frontier: DataFrame) -> DataFrame:
        """The steps from the nodes of ``frontier`` (src and whatever it carries)."""
        return salted_join(self.df, frontier, ["src"], rows_per_salt=self.rows_per_salt, hot=self.hot)


@dataclass(frozen=True)
class Walk:
    nodes: DataFrame
    truncated: bool = False


def window(starts: DataFrame, adjacency: DataFrame, low: int, high: int, budget: int | None = None) -> Walk:
    """(id) of the nodes that some walk of length low..high reaches from ``starts`` (id).

    There is no visited set: a start comes out again where a cycle leads back to it. Each level is made distinct. With a
    ``budget`` of nodes over all levels together, the level that exceeds it is cut to its smallest ids and ends the walk.
    """
    level, kept, left, cut = starts.select("id").distinct(), [], budget, False
    steps = Steps(adjacency)
    for depth in range(1, high + 1):
        level = steps.ahead(level.select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct()
        if budget is not None:
            level = materialize(level.orderBy("id").limit(left + 1))
            size = level.count()
            if size > left:
                level, cut = level.orderBy("id").limit(left), True
            left -= min(size, left)
            if not size:
                break
        elif depth % LEVELS_AT_ONCE == 0 and depth < high:
            level = materialize(level)
            if not level.take(1):
                break
        if depth >= low:
            kept.append(level)
        if cut:
            break
    if not kept:
        return Walk(starts.select("id").where("false"), cut)
    every = kept[0]
    for k in kept[1:]:
        every = every.union(k)
    return Walk(every.distinct() if len(kept) > 1 else every, cut)


def pair_window(starts: DataFrame, adjacency: DataFrame, low: int, high: int) -> DataFrame:
    """(origin, id): as ``window``, separately for every start."""
    level = starts.select(F.col("id").alias("origin"), "id").distinct()
    steps = Steps(adjacency)
    kept = []
    for depth in range(1, high + 1):
        level = steps.ahead(level.select("origin", F.col("id").alias("src"))).select("origin", F.col("dst").alias("id")).distinct()
        if depth % LEVELS_AT_ONCE == 0 and depth < high:
            level = materialize(level)
            if not level.take(1):
                break
        if depth >= low:
            kept.append(level)
    every = kept[0] if kept else level.where("false")
    for k in kept[1:]:
        every = every.union(k)
    return every.distinct()


def bfs(starts: DataFrame, adjacency: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, depth, parent): every node reached from ``starts`` (id), at its least depth; starts have depth 0 and no parent.

    Of several parents at that depth the smallest id counts. ``deepest`` None goes on until nothing new is reached.
    """
    steps = Steps(adjacency)
    known = materialize(starts.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    frontier, depth, parts = known, 0, [known]
    while deepest is None or depth < deepest:
        # A few levels in one job. A node that comes out again deeper, or was known before, only adds rows that lose here.
        near, levels = frontier, []
        for _ in range(LEVELS_AT_ONCE if deepest is None else min(LEVELS_AT_ONCE, deepest - depth)):
            depth += 1
            near = steps.ahead(near.select(F.col("id").alias("src"))).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            levels.append(near.select("id", F.lit(depth).alias("depth"), "parent"))
        first = reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min(F.struct("depth", "parent")).alias("m"))
        new = materialize(first.join(known.select("id"), "id", "left_anti").select("id", "m.depth", "m.parent"))
        parts.append(new)
        known = reduce(DataFrame.unionByName, parts)
        if len(parts) > DELTAS:
            known = materialize(known)
            parts = [known]
        frontier = new.where(F.col("depth") == depth)
        if not frontier.take(1):
            break
    return known


def closure(adjacency: DataFrame, starts: DataFrame | None = None, deepest: int | None = None, without: tuple[str, str] | None = None) -> DataFrame:
    """(src, dst): every pair with a walk of at least one step, semi-naive: only pairs new in a round are extended.

    ``without`` names two columns of bits, of the source and of the end of each step: pairs that share a bit are left out, and
    not extended.

    ``starts`` (id) limits the sources. The result has as many rows as there are reachable pairs. Rounds add one step
    while that is cheap; on deep graphs, where joining what is farthest with all that is known costs no more than a few
    times the known pairs, a round doubles the distance instead, so depth costs its logarithm in rounds.
    """
    out, into = without or (None, None)
    bits = list(without or ())
    steps = materialize(adjacency.select("src", "dst", *bits).distinct())
    first = steps if starts is None else steps.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    parts = [first.withColumn("dist", F.lit(1))]  # what each round found; together all that is known
    known, far, depth = parts[0], parts[0], 1
    while deepest is None or depth < deepest:
        ahead, reach = steps.withColumn("dist", F.lit(1)), 1
        if starts is None and deepest is None and depth >= DOUBLE_FROM and _product(far, known) <= DOUBLE_COST * known.count():
            ahead, reach = known, depth
        more = far.select("src", F.col("dst").alias("mid"), *bits[:1]).join(ahead.select(F.col("src").alias("mid"), "dst", "dist", *bits[1:]), "mid")
        if bits:
            more = more.where(F.col(out).bitwiseAND(F.col(into)) == 0)
        found = more.groupBy("src", "dst", *bits).agg((F.min("dist") + depth).alias("dist"))
        new = materialize(found.join(known.select("src", "dst"), ["src", "dst"], "left_anti"))
        depth += reach
        far = new.where(F.col("dist") == depth)
        if not new.take(1):
            break
        parts.append(new.select("src", "dst", *bits, "dist"))
        known = reduce(DataFrame.unionByName, parts)
        if len(parts) > DELTAS:
            known = materialize(known)
            parts = [known]
        if not far.take(1):
            break
    return known.select("src", "dst")


def compose(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst), each once, of ``left`` (src, mid) and ``right`` (mid, dst), both distinct and with whole numbers as dst.

    Where many ways lead from one to the other, ends travel as bit sets, so that ways are put together before they are shuffled.
    """
    width = WORDS * 64
    block = F.shiftright("dst", width.bit_length() - 1)
    ahead = right.select("mid", F.col("dst").cast("long").alias("dst")).repartition("mid").groupBy("mid", block.alias("block"))
    rows = ahead.agg(F.count(F.lit(1)).alias("n")).groupBy("mid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))
    ways = left.groupBy("mid").agg(F.count(F.lit(1)).alias("m")).join(rows, "mid").agg(F.sum(F.col("m") * F.col("n")), F.sum(F.col("m") * F.col("blocks"))).first()
    if (ways[0] or 0) < DENSE * (ways[1] or 0) or not ways[0]:
        return left.join(right, "mid").select("src", "dst").distinct()
    place, bit = F.pmod(F.col("dst"), F.lit(width)), F.lit(1).cast("long")
    word = lambda i: F.when(F.floor(place / 64) == i, F.call_function("shiftleft", bit, F.pmod(F.col("dst"), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    words = [f"w{i}" for i in range(WORDS)]
    sets = ahead.agg(*[F.bit_or(word(i)).alias(w) for i, w in enumerate(words)])
    met = left.join(sets, "mid").groupBy("src", "block").agg(*[F.bit_or(w).alias(w) for w in words])
    each = met.select("src", "block", F.posexplode(F.array(*words)).alias("at", "word")).where("word <> 0")
    each = each.select("src", "block", "at", "word", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("bit"))
    hit = F.call_function("shiftright", F.col("word"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    return each.where(hit).select("src", (F.col("block") * width + F.col("at") * 64 + F.col("bit")).cast(right.schema["dst"].dataType).alias("dst"))


def marks(starts: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(id, mask): at each node the bits of all ``starts`` (id, mask) that reach it, themselves included."""
    steps = Steps(adjacency)
    known = materialize(starts.groupBy("id").agg(F.bit_or("mask").alias("mask")))
    frontier, more = known, True
    while more:
        near, levels = frontier, []
        for _ in range(LEVELS_AT_ONCE):
            near = steps.ahead(near.select(F.col("id").alias("src"), "mask")).groupBy(F.col("dst").alias("id")).agg(F.bit_or("mask").alias("mask"))
            levels.append(near.withColumn("last", F.lit(0).cast("long")))
        levels[-1] = near.withColumn("last", F.col("mask"))
        found = reduce(DataFrame.unionByName, [*levels, known.withColumn("last", F.lit(0).cast("long"))]).groupBy("id").agg(F.bit_or("mask").alias("mask"), F.bit_or("last").alias("last"))
        was = known.select("id", F.col("mask").alias("was"))
        # What the last level brought goes on, if it was not known before these levels.
        found = found.join(was, "id", "left").select("id", "mask", F.col("last").bitwiseAND(F.bitwise_not(F.coalesce("was", F.lit(0).cast("long")))).alias("last"))
        found = materialize(found)
        known, frontier = found.select("id", "mask"), found.where("last <> 0").select("id", F.col("last").alias("mask"))
        more = bool(frontier.take(1))
    return known


def reaching(adjacency: DataFrame, sizes: DataFrame, hubs: int = HUBS) -> DataFrame:
    """(id, n): the summed ``sizes`` (id, size) of all other nodes that reach each node of a graph without cycles; none is left out.

    What reaches one of the few hubs (the largest products of ways in and out) also reaches all that the hub reaches. Those
    pairs are counted by the sets of hubs that nodes reach and are reached by; only pairs that no hub lies between are made.
    """
    steps = materialize(adjacency.select("src", "dst").distinct())
    degree = steps.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ins")).join(steps.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outs")), "id")
    chosen = [r["id"] for r in degree.orderBy((F.col("ins") + 1) * (F.col("outs") + 1) * -1, "id").limit(hubs).collect()]
    kind = steps.schema["src"].dataType.simpleString()
    at = steps.sparkSession.createDataFrame([(h, 1 << i) for i, h in enumerate(chosen)], f"id {kind}, mask bigint")
    into = marks(at, steps)
    out = marks(at, steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    none = F.lit(0).cast("long")
    marked = steps.join(out.toDF("src", "out"), "src", "left").join(into.toDF("dst", "into"), "dst", "left").select("src", "dst", F.coalesce("out", none).alias("out"), F.coalesce("into", none).alias("into"))
    pairs = closure(marked.where(F.col("out").bitwiseAND(F.col("into")) == 0), without=("out", "into"))
    made = pairs.join(sizes.toDF("src", "size"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("size").alias("n"))
    behind = out.join(sizes, "id").groupBy(F.col("mask").alias("out")).agg(F.sum("size").alias("size"))
    covered = into.select(F.col("mask").alias("into")).distinct().join(F.broadcast(behind), F.col("out").bitwiseAND(F.col("into")) != 0).groupBy("into").agg(F.sum("size").alias("n"))
    counted = into.join(covered.withColumnRenamed("into", "mask"), "mask").select("id", "n")
    own = at.join(sizes, "id").select("id", (-F.col("size")).alias("n"))  # a hub is behind itself
    return made.union(counted).union(own).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")


def _product(far: DataFrame, known: DataFrame) -> int:
    """Rows of the join of ``far`` with ``known`` where one ends and the other begins, without making it."""
    a = far.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("a"))
    b = known.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "mid").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def distances(targets: DataFrame, adjacency: DataFrame, deepest: int | None) -> DataFrame:
    """(id, dist): least number of steps from each node to any target, at most ``deepest`` where that is given."""
    back = adjacency.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs(targets, back, deepest).select("id", F.col("depth").alias("dist"))


@dataclass(frozen=True)
class Paths:
    """``rows``: start, target, length, trail (all ids from start to target). ``depth_limited``: longer walks were left."""

    rows: DataFrame
    truncated: bool = False
    depth_limited: bool = False


def simple_paths(starts: DataFrame, targets: DataFrame, adjacency: DataFrame, low: int = 1, high: int | None = 8, budget: int | None = None) -> Paths:
    """All simple paths of the least length in low..high from each start to any target; ``high`` None is no bound.

    A path repeats no node, but may end at its own start. A start stops at the first length with a path. Only nodes near
    enough to a target are walked; with low = 1 only such as lie on a shortest path. With a ``budget`` of partial walks
    in one level, a level beyond it is discarded and the search ends, truncated.
    """
    steps = materialize(adjacency.select("src", "dst").distinct())
    goals = materialize(targets.select("id").distinct())
    dist = materialize(distances(goals, steps, high))
    near = steps.join(dist.withColumnRenamed("id", "dst"), "dst")
    near = materialize(near.select("src", "dst", "dist"))
    goal_flag = goals.select(F.col("id").alias("dst"), F.lit(True).alias("is_goal"))
    steps_to = materialize(near.join(goal_flag, "dst", "left").select("src", "dst", "dist", F.coalesce("is_goal", F.lit(False)).alias("is_goal")))
    walks = starts.select("id").distinct().select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("trail"))
    if low == 1:
        # The length of a start's shortest paths is known before they are walked.
        best = steps_to.groupBy(F.col("src").alias("start")).agg((F.min("dist") + 1).alias("best"))
        walks = walks.join(best, "start")
    else:
        walks = walks.withColumn("best", F.lit(2**31 - 1 if high is None else high))
    found, cut, more = [], False, False
    for depth in count(1) if high is None else range(1, high + 1):
        back = F.col("dst") == F.col("start")
        reach = walks.join(steps_to, walks["node"] == steps_to["src"]).where(
            (F.col("dist") + depth <= F.col("best")) & (~F.array_contains("trail", F.col("dst")) | (back & F.col("is_goal") & (depth >= low)))
        )
        level = materialize(reach.select("start", F.col("dst").alias("node"), F.concat("trail", F.array("dst")).alias("trail"), "best", "is_goal"))
        size = level.limit(budget + 1).count() if budget is not None else (1 if level.take(1) else 0)
        if not size:
            break
        if budget is not None and size > budget:
            cut = True
            break
        if depth >= low:
            hits = level.where("is_goal")
            found.append(hits.select("start", F.col("node").alias("target"), F.lit(depth).alias("length"), "trail"))
            if low == 1:  # a start ends at the length of its shortest paths
                level = level.where(F.col("best") > depth)
            else:
                level = level.join(hits.select("start").distinct(), "start", "left_anti")
        walks = level.where(F.col("node") != F.col("start")).select("start", "node", "trail", "best")
        more = depth == high
    limited = bool(more and walks.take(1))
    if not found:
        return Paths(walks.select("start", F.col("node").alias("target"), F.lit(0).alias("length"), "trail").where("false"), cut, limited)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return Paths(rows, cut, limited)


def first_routes(starts: DataFrame, adjacency: DataFrame, deepest: int | None = None, order: Column | None = None) -> DataFrame:
    """(id, depth, route): to every node reached from ``starts`` one shortest route, of several the lexicographically least.

    ``route`` is the array of node names from the start; names are the ids, or ``order`` of them.
    """
    steps = materialize(adjacency)
    name = F.col("id") if order is None else order
    known = materialize(starts.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array(name).alias("route")))
    frontier, depth = known, 0
    while deepest is None or depth < deepest:
        depth += 1
        ahead = frontier.select(F.col("id").alias("src"), "route").join(steps, "src").withColumn("id", F.col("dst"))
        best = ahead.groupBy("id").agg(F.min(F.concat("route", F.array(name))).alias("route"))
        frontier = materialize(best.join(known.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "route"))
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
    return known


def one_route(adjacency: DataFrame, start: int | str, end: int | str, deepest: int | None = None) -> list:
    """The least of the shortest routes from one node to another, as a list of nodes; empty where there is none.

    Only distances to the end are computed for the graph; the route itself is one node longer than it has steps.
    """
    steps = materialize(adjacency.select("src", "dst").distinct())
    kind = steps.schema["dst"].dataType
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    goal = steps.sparkSession.range(1).select(F.lit(end).cast(kind).alias("id"))
    known = goal.withColumn("depth", F.lit(0))
    frontier, depth = materialize(known), 0
    known, route = frontier, [start] if start == end else []
    while not route and (deepest is None or depth < deepest):
        depth += 1
        reached = frontier.select(F.col("id").alias("src")).join(back, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(reached.join(known.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        known = known.unionByName(frontier)
        if depth % 8 == 0:
            known = materialize(known)
        if frontier.where(F.col("id") == F.lit(start)).take(1):
            route = [start]
    for left in range(depth - 1, -1, -1) if route and start != end else ():
        ahead = steps.where(F.col("src") == F.lit(route[-1])).select(F.col("dst").alias("id")).join(known.where(F.col("depth") == left), "id")
        route.append(ahead.agg(F.min("id")).first()[0])
    return route


def components(adjacency: DataFrame) -> DataFrame:
    """(id, component, size): strongly connected components, named by their least id.

    Trimming first: nodes without a way in or without a way out are components of their own. What remains is coloured:
    the least id that can reach a node is its colour, and the nodes of a colour that reach its namesake backwards are a
    component; they are taken out, and the rest goes round again.
    """
    ends = adjacency.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    left = materialize(adjacency.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while size := left.count():
        # Trim until nothing more falls off: colouring takes many rounds for each one of these.
        while size:
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            left, before = materialize(kept.select("src", "dst")), size
            size = left.count()
            if size == before:
                break
        if not size:
            break
        colour = materialize(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            after = colour.select("id", "colour", F.col("colour").alias("was"))
            for _ in range(LEVELS_AT_ONCE):
                sent = left.join(after.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
                after = after.join(sent, "id", "left").select("id", F.least("colour", "c").alias("colour"), "was")
            after = materialize(after)
            colour = after.select("id", "colour")
            if not after.where("colour < was").take(1):
                break
        inner = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = materialize(inner.where("a = b").select("src", "dst", F.col("a").alias("colour")))
        # Backwards from the namesake of each colour, inside the colour.
        part = materialize(colour.where("id = colour").select("id", "colour"))
        frontier = part
        while True:
            near = frontier
            for _ in range(LEVELS_AT_ONCE):
                up = near.select(F.col("id").alias("dst"), "colour").join(inner, ["dst", "colour"]).select(F.col("src").alias("id"), "colour")
                near = near.union(up).distinct()
            frontier = materialize(near.join(part, ["id", "colour"], "left_anti"))
            if not frontier.take(1):
                break
            part = materialize(part.unionByName(frontier))
        done.append(part.select("id", F.col("colour").alias("component")))
        gone = part.select("id")
        left = materialize(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    named = ends.withColumn("component", F.col("id"))
    if done:
        parts = done[0]
        for d in done[1:]:
            parts = parts.unionByName(d)
        parts = materialize(parts)
        named = ends.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("id", "component", "size")
