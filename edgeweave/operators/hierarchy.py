"""Parent-child links to full hierarchies by bottom-up leaf peeling.

Upwards, each round takes off all leaves; they send their subtree sizes to their parents. So that deep trees do not take as
many rounds as they are high, a round also takes nodes out of chains: of the nodes with one child, those whose (hashed)
number is larger than that of the parent and of the child hand their child on to their parent. No two neighbours go at
once, and about a third of every chain goes in each round, so any forest, and any cycle, is peeled in rounds of the order
of the logarithm of its nodes. Trees vanish completely; what is left of a cycle is one node that is its own parent.

Downwards, the rounds are taken in reverse: whatever a node was sent to when it was peeled is known by then, which gives
its path, depth and root. Rounds shrink by a constant factor, so both ways write a small multiple of the nodes.

Descendant lists travel the same way, as rows: a peeled node sends itself and all it holds to the node above; a node taken
out of a chain gets the list of its child on the way down.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ROWS_PER_SALT, materialize, salted_join, tidy

#: Rounds after which the driver is tidied up.
TIDY_EVERY = 3

_KEY = ["tree", "node"]
_PLACED = ["tree", "node", "root", "depth", "path", "state", "below"]
_BENEATH = ["tree", "node", "descendant", "distance"]


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: tree, node, root, depth, path, state, below. ``descendants``: tree, node, descendant, distance, or None."""

    nodes: DataFrame
    descendants: DataFrame | None
    rounds: int


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in no more partitions than a shuffle has; unions of all rounds would double them each time."""
    return materialize(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def node_table(links: DataFrame) -> DataFrame:
    """(tree, node, up, open children, xor of the children's ids) from (tree, child, parent) links.

    A second parent loses to the smallest. The only child of a node is the xor of its open children.
    """
    clean = links.select("tree", "child", "parent").where("tree is not null")
    # One shuffle: each link says of its child who the parent is, and of its parent that it exists.
    said = clean.select(
        "tree",
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.when(F.col("child").isNotNull(), F.col("parent")).alias("up")),
                F.struct(F.col("parent").alias("node"), F.lit(None).cast("long").alias("up")),
            )
        ).alias("s"),
    ).select("tree", "s.node", "s.up")
    nodes = materialize(said.where("node is not null").groupBy(*_KEY).agg(F.min("up").alias("up")))
    children = nodes.where("up is not null").groupBy("tree", F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("open"), F.bit_xor("node").alias("kids"))
    zero = F.lit(0).cast("long")
    return nodes.join(children, _KEY, "left").select("tree", "node", "up", F.coalesce("open", zero).alias("open"), F.coalesce("kids", zero).alias("kids"))


# What a node is on the way up: its pointer and how it looks (gap: links up to it; trail: ids below it, down to the node;
# least: smallest id among these), its open children, the peeled nodes beneath it, and leaves it lost in the last round.
# ``turn`` counts the rounds; as a column it leaves the plan of every round the same, which is compiled once.
_STATE = ["up", "gap", "trail", "least", "open", "kids", "acc", "lost", "turn", "cut"]


def _posted(df: DataFrame, *messages) -> DataFrame:
    """One exchange: the state of every node of ``df`` with the messages that were sent to it added to it.

    A message is (condition, target, its values); the aggregation combines them before they are shuffled, so a parent
    with any number of children gets one row per task.
    """
    kinds = {"new_up": "bigint", "more_gap": "int", "head": "string", "low": "bigint", "gone": "bigint", "flip": "bigint", "add": "bigint"}
    blank = {n: F.lit(None).cast(t) for n, t in kinds.items()}

    def post(target, own, values) -> F.Column:
        return F.struct(target.alias("node"), own.alias("own"), *[values.get(n, blank[n]).alias(n) for n in kinds])

    state = F.struct(*_STATE)
    own = F.when(F.col("stays"), post(F.col("node"), state, {}))
    sent = [F.when(when, post(target, F.lit(None).cast(df.select(state.alias("s")).schema[0].dataType), values)) for when, target, values in messages]
    rows = df.select("tree", F.explode(F.array_compact(F.array(own, *sent))).alias("m")).select("tree", "m.*")
    got = rows.groupBy(*_KEY).agg(
        F.max("own").alias("own"), *[F.max(n).alias(n) for n in ("new_up", "more_gap", "head")], F.min("low").alias("low"),
        F.sum("gone").alias("gone"), F.bit_xor("flip").alias("flip"), F.sum("add").alias("add"),
    )
    zero = F.lit(0).cast("long")
    trail = F.when(F.col("head").isNull(), F.col("own.trail")).otherwise(F.concat("head", F.lit("/"), F.col("own.trail")))
    return got.where("own is not null").select(
        *_KEY,
        F.coalesce("new_up", "own.up").alias("up"),
        (F.col("own.gap") + F.coalesce("more_gap", F.lit(0))).alias("gap"),
        trail.alias("trail"),
        F.least("own.least", "low").alias("least"),
        (F.col("own.open") - F.coalesce("gone", zero)).alias("open"),
        F.col("own.kids").bitwiseXOR(F.coalesce("flip", zero)).alias("kids"),
        (F.col("own.acc") + F.coalesce("add", zero)).alias("acc"),
        F.coalesce("gone", "own.lost").alias("lost"),
        (F.col("own.turn") + 1).alias("turn"),
        F.col("own.cut").alias("cut"),
    )


def _round(alive: DataFrame) -> DataFrame:
    """The nodes of ``alive`` without its leaves; those taken out of chains have ``cut``, and what they handed on is done."""
    raked = _posted(
        alive.withColumn("lost", F.lit(0).cast("long")).withColumn("stays", F.col("open") > 0),
        (F.expr("open = 0 and up is not null"), F.col("up"), {"gone": F.lit(1).cast("long"), "flip": F.col("node"), "add": F.col("acc") + 1}),
    )
    rank = lambda c: F.xxhash64("tree", c, "turn")
    out = (F.col("open") == 1) & F.col("up").isNotNull() & (rank("node") > rank("up")) & (rank("node") > rank("kids"))
    marked = raked.withColumn("cut", F.coalesce(out, F.lit(False))).withColumn("stays", F.lit(True))
    return _posted(
        marked,
        (F.col("cut"), F.col("kids"), {"new_up": F.col("up"), "more_gap": F.col("gap"), "head": F.col("trail"), "low": F.col("least")}),
        (F.col("cut"), F.col("up"), {"flip": F.col("node").bitwiseXOR(F.col("kids")), "add": F.col("acc") + 1}),
    )


def peel(links: DataFrame, with_descendants: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> Hierarchy:
    """Full hierarchies of the ``links`` (tree STRING, child BIGINT, parent BIGINT).

    Every id in a link with a ``tree`` is a node, also where the other end is null. The same pair twice is one link; of
    several parents the smallest id counts. ``state`` is ``tree`` (path of ids joined by ``/``, depth 0 at the root),
    ``in_cycle`` or ``below_cycle`` (root: least id of the cycle, depth -1, empty path). ``below`` counts the descendants
    of a node; on a cycle, where every node is beneath every other, it is null. ``descendants`` has a row for each ``tree``
    node and each node beneath it, with the distance. No links give no rows.
    """
    zero = F.lit(0).cast("long")
    alive = node_table(links).select(
        *_KEY, "up", F.lit(1).alias("gap"), F.col("node").cast("string").alias("trail"), F.col("node").alias("least"), "open", "kids", zero.alias("acc"), zero.alias("lost"), F.lit(0).alias("turn"), F.lit(False).alias("cut")
    )
    alive = _kept(alive)
    leaves: list[DataFrame] = []  # peeled as leaves, by round
    chained: list[DataFrame] = []  # taken out of chains, by round
    crowded: list[bool] = []  # whether a node lost so many leaves at once that the way down needs salts
    busy = alive.where("up is null or up <> node").limit(1).count()
    while busy:
        after = _kept(_round(alive))
        leaves.append(alive.where("open = 0"))
        chained.append(after.where("cut"))
        alive = after.where("not cut")
        busy, most = after.agg(F.count_if(F.expr("not cut and (up is null or up <> node)")), F.max("lost")).first()
        crowded.append((most or 0) > rows_per_salt)
        if len(leaves) % TIDY_EVERY == 0:
            tidy(links.sparkSession)

    # Nodes of cycles that are left stand for their cycle.
    known = alive.select(*_KEY, F.col("least").alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path"), F.lit("in_cycle").alias("state"), F.lit(None).cast("long").alias("below"))
    for n in reversed(range(len(leaves))):
        known = _placed(known, leaves[n], chained[n], crowded[n], rows_per_salt)
        if n or with_descendants:
            known = _kept(known)  # a table of all rounds so far; the next one is larger by a constant factor
        if n % TIDY_EVERY == 0:
            tidy(links.sparkSession)
    return Hierarchy(known, _beneath(known, leaves, chained) if with_descendants else None, len(leaves))


def _placed(known: DataFrame, leaves: DataFrame, chained: DataFrame, crowded: bool, rows_per_salt: int) -> DataFrame:
    """``known`` with the nodes of one more round of peeling: first those of chains, then the leaves."""
    above = lambda df: df.drop("below").toDF(*[c if c == "tree" else f"up_{c}" for c in _PLACED[:-1]]).withColumnRenamed("up_node", "up")
    under = known.select("tree", F.col("node").alias("kids"), F.col("root").alias("kid_root"), F.col("state").alias("kid_state"), F.col("below").alias("kid_below"))
    ring, hangs = F.col("kid_state") == "in_cycle", F.col("up_state") == "tree"
    depth = F.when(hangs, F.col("up_depth") + F.col("gap")).otherwise(F.lit(-1)).alias("depth")
    path = F.when(hangs, F.concat("up_path", F.lit("/"), "trail")).otherwise(F.lit("")).alias("path")
    back = chained.join(above(known), ["tree", "up"]).join(under, ["tree", "kids"]).select(
        *_KEY,
        F.when(ring, F.col("kid_root")).otherwise(F.col("up_root")).alias("root"),
        depth,
        path,
        F.when(ring, "in_cycle").when(hangs, "tree").otherwise("below_cycle").alias("state"),
        F.when(~ring, F.col("acc") + 1 + F.col("kid_below")).alias("below"),
    )
    back = known.unionByName(back)
    hung = leaves.where("up is not null").select(*_KEY, "up", "gap", "trail", "acc")
    hung = salted_join(hung, above(back), ["tree", "up"], rows_per_salt=rows_per_salt) if crowded else hung.join(above(back), ["tree", "up"])
    hung = hung.select(*_KEY, F.col("up_root").alias("root"), depth, path, F.when(hangs, "tree").otherwise("below_cycle").alias("state"), F.col("acc").alias("below"))
    roots = leaves.where("up is null").select(*_KEY, F.col("node").alias("root"), F.lit(0).alias("depth"), "trail", F.lit("tree").alias("state"), "acc").toDF(*_PLACED)
    return back.unionByName(hung).unionByName(roots)


def _beneath(out: DataFrame, leaves: list[DataFrame], chained: list[DataFrame]) -> DataFrame:
    """Descendant lists, sent up in the order of peeling; nodes of chains get the list of their child in reverse order."""
    if not leaves:
        return out.select(*_KEY, F.col("node").alias("descendant"), F.lit(0).alias("distance")).where("false")
    when = [a.select(*_KEY, "up", "gap", "kids") for pair in zip(leaves, chained) for a in pair]
    peeled = reduce(DataFrame.unionByName, [a.withColumn("t", F.lit(t)) for t, a in enumerate(when)])
    tree = out.where("state = 'tree'").select(*_KEY, "depth")
    peeled = peeled.join(tree, _KEY)
    times = peeled.select("tree", F.col("node").alias("up"), F.col("t").alias("up_t"))
    peeled = materialize(peeled.join(times, ["tree", "up"], "left").select(*_KEY, "up", "gap", "kids", "depth", "t", "up_t"))
    lists: list[DataFrame] = []  # rows that are final
    held: list[DataFrame] = []  # (tree, node, descendant, distance, t: when the node is peeled)
    for t in range(len(when)):
        now = peeled.where((F.col("t") == t) & F.col("up_t").isNotNull())
        sent = now.select("tree", F.col("up").alias("node"), F.col("node").alias("descendant"), F.col("gap").alias("distance"), F.col("up_t").alias("t"))
        mine = [h.where(F.col("t") == t).drop("t") for h in held]
        if mine:
            on = reduce(DataFrame.unionByName, mine).join(now.select(*_KEY, "up", "gap", "up_t"), _KEY)
            sent = sent.unionByName(on.select("tree", F.col("up").alias("node"), "descendant", (F.col("distance") + F.col("gap")).alias("distance"), F.col("up_t").alias("t")))
        held.append(_kept(sent))
        if len(held) > 5:  # plans with many small tables cost more than writing what is still needed once more
            lists.append(_kept(reduce(DataFrame.unionByName, held).where(F.col("t") <= t).select(*_BENEATH)))
            held = [_kept(reduce(DataFrame.unionByName, held).where(F.col("t") > t))]
    lists += [h.select(*_BENEATH) for h in held]
    depth = peeled.select("tree", F.col("node").alias("kids"), F.col("depth").alias("kid_depth"))
    for t in reversed(range(1, len(when), 2)):
        links = peeled.where(F.col("t") == t).join(depth, ["tree", "kids"]).select(*_KEY, "kids", (F.col("kid_depth") - F.col("depth")).alias("step"))
        below = reduce(DataFrame.unionByName, lists).withColumnRenamed("node", "kids").join(links, ["tree", "kids"])
        more = below.select(*_KEY, "descendant", (F.col("distance") + F.col("step")).alias("distance"))
        # Lists of nodes of the same round do not build on each other.
        lists.append(_kept(more.unionByName(links.select(*_KEY, F.col("kids").alias("descendant"), F.col("step").alias("distance")))))
    return reduce(DataFrame.unionByName, lists)
