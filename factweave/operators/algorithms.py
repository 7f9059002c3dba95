"""Graph algorithms over ``edges`` (``src, rel, dst``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.scratch import checkpoint

#: After so many rounds what a side of a search has reached is written as one table, so plans stay short on deep graphs.
MERGED = 16
#: So many objects at most are sent to all executors, through the driver.
FEW = 50_000


def _sized(objects: DataFrame, n: int) -> DataFrame:
    """A side of a join of n rows at most: broadcast if they are few, else neither side is.

    Left to itself Spark takes relationships for as small as the files they are made from, and broadcasts them.
    """
    return F.broadcast(objects) if n <= FEW else objects.hint("merge")


class _Side:
    """One side of a search: its layers of objects (``node, next``), the newest last. ``next``: the least object a step nearer to the goal."""

    def __init__(self, node: int, spark: SparkSession, near: str, far: str):
        self.near, self.far, self.sizes = near, far, [1]
        self.layers = [spark.createDataFrame([(node, None)], "node long, next long")]
        self.reached = self.layers[0].select("node")

    @property
    def size(self) -> int:
        """Of the newest layer."""
        return self.sizes[-1]

    def step(self, edges: DataFrame, other: "_Side") -> bool:
        """Adds a layer; true if it meets the other side's newest one."""
        front = self.layers[-1].select(F.col("node").alias("at"))
        new = edges.join(_sized(front, self.size), F.col(self.near) == F.col("at")).groupBy(F.col(self.far).alias("node")).agg(F.min("at").alias("next"))
        new = new.join(_sized(self.reached, sum(self.sizes)), "node", "left_anti")
        met = other.layers[-1].select("node", F.lit(True).alias("met"))
        layer = checkpoint(new.join(_sized(met, other.size), "node", "left").select("node", "next", "met"))
        found = layer.agg(F.count(F.lit(1)).alias("n"), F.max("met").alias("met")).first()
        self.sizes.append(found["n"])
        self.layers.append(layer.select("node", "next"))
        self.reached = self.reached.unionByName(layer.select("node"))
        if len(self.layers) % MERGED == 0:
            self.reached = checkpoint(self.reached.distinct())
        return bool(found["met"])


def shortest_path(edges: DataFrame, start: int, end: int, rel: str, most: int | None = None) -> DataFrame:
    """``pos, obj_id``: the least, in the order of its ids, of the shortest directed paths; no rows if there is none.

    Two-sided, level by level: the side with the smaller frontier takes a step, joining it with the relationships, and leaves out what
    it has reached before. Rows are an object and the next one, never a path. Where the sides meet, the layers before
    are narrowed to what leads there, and the path is read off, one row from each layer. It ends when a side finds nothing
    new; if ``most`` relationships are given and don't suffice, it fails.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "pos int, obj_id long")
    own = edges.where(F.col("rel") == rel).select("src", "dst")
    ahead, behind = _Side(start, spark, "src", "dst"), _Side(end, spark, "dst", "src")
    met = False
    while not met:
        if len(ahead.layers) + len(behind.layers) - 2 == most:
            raise ValueError(f"no path of {most} relationships or fewer, but longer ones were not looked for")
        side, other = (ahead, behind) if ahead.size <= behind.size else (behind, ahead)
        met = side.step(own, other)
        if not side.size:
            return spark.createDataFrame([], "pos int, obj_id long")
    goal = ahead.layers[-1].join(_sized(behind.layers[-1].select("node"), behind.size), "node", "left_semi").select(F.col("node").alias("to"))
    leads, most_goals = [], min(ahead.size, behind.size)
    for layer, n in zip(reversed(ahead.layers[:-1]), reversed(ahead.sizes[:-1])):
        step = own.join(_sized(layer.select(F.col("node").alias("src")), n), "src", "left_semi").join(_sized(goal, most_goals), F.col("dst") == F.col("to"))
        most_goals = n
        leads.append(checkpoint(step.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))))
        goal = leads[-1].select(F.col("node").alias("to"))
    path = [start]
    for layer in [*reversed(leads), *reversed(behind.layers[1:])]:
        path.append(layer.where(F.col("node") == path[-1]).first()["next"])
    return spark.createDataFrame(list(enumerate(path)), "pos int, obj_id long")


def _oriented(edges: DataFrame, rel: str) -> DataFrame:
    """``a, b, up, down`` of each two different objects that are related: a has fewer neighbours (ties: the smaller id); 1 if a to b, b to a."""
    least, greatest = F.least("src", "dst"), F.greatest("src", "dst")
    own = edges.where((F.col("rel") == rel) & (F.col("src") != F.col("dst")))
    pairs = own.groupBy(least.alias("x"), greatest.alias("y")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("xy"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("yx"))
    degree = pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    of = lambda end: degree.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    first = F.col("n_x") <= F.col("n_y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return both.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("xy", "yx").alias("up"), pick("yx", "xy").alias("down"))


def _closed(edges: DataFrame, rel: str) -> DataFrame:
    """Sets of three related objects, once each, with the directions of their three pairs.

    Pairs point from fewer neighbours to more, so an object is the first of few pairs, however many it is the second of: of
    m pairs no more than m * sqrt(2 m) steps of two are met, hubs or not.
    """
    own = _oriented(edges, rel)
    named = lambda a, b, k: own.select(F.col("a").alias(a), F.col("b").alias(b), F.col("up").alias(f"up{k}"), F.col("down").alias(f"down{k}"))
    return named("a", "b", 1).join(named("b", "c", 2), "b").join(named("a", "c", 3), ["a", "c"])


def transitive_triples(edges: DataFrame, rel: str) -> DataFrame:
    """How many (u, v, w) have u to v, v to w and u to w: one row ``n``. Objects related to themselves may stand twice."""
    up1, up2, up3, down1, down2, down3 = (F.col(f"{way}{k}") for way in ("up", "down") for k in (1, 2, 3))
    orders = up1 * up2 * up3 + up3 * down2 * up1 + down1 * up3 * up2 + up2 * down3 * down1 + down3 * up1 * down2 + down2 * down1 * down3
    apart = _closed(edges, rel).agg(F.coalesce(F.sum(orders), F.lit(0)).alias("n"))
    own = edges.where(F.col("rel") == rel).select("src", "dst").distinct()
    loops = own.where("src = dst").select(F.col("src").alias("loop"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    out = count(own.join(loops, F.col("src") == F.col("loop"), "left_semi"))  # u = v
    into = count(own.where("src <> dst").join(loops, F.col("dst") == F.col("loop"), "left_semi"))  # v = w
    back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = count(own.where("src <> dst").join(back, ["src", "dst"], "left_semi").join(loops, F.col("src") == F.col("loop"), "left_semi"))  # u = w
    return apart.unionByName(out).unionByName(into).unionByName(both).agg(F.sum("n").alias("n"))


def triangles(edges: DataFrame, rel: str) -> DataFrame:
    """Transitive triples divided by three, down; 0 where fewer than three objects have such a relationship."""
    sources = edges.where(F.col("rel") == rel).agg(F.countDistinct("src").alias("sources"))
    both = transitive_triples(edges, rel).unionByName(sources, allowMissingColumns=True).agg(F.max("n").alias("n"), F.max("sources").alias("sources"))
    return both.select(F.when(F.col("sources") < 3, F.lit(0)).otherwise(F.floor(F.col("n") / 3)).cast("long").alias("triangles"))


def triangles_undirected(edges: DataFrame, rel: str) -> DataFrame:
    """Sets of three objects of which each two are related either way."""
    return _closed(edges, rel).agg(F.count(F.lit(1)).alias("triangles"))


def degrees(edges: DataFrame, rel: str) -> DataFrame:
    """``obj_id, n``: how many distinct relationships go out."""
    return edges.where(F.col("rel") == rel).distinct().groupBy(F.col("src").alias("obj_id")).agg(F.count(F.lit(1)).alias("n"))


def node_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame, rels: list[str]) -> DataFrame:
    """``start`` and ``obj_id`` after following the given relationships in turn."""
    out = starts.select(F.col("obj_id").alias("start"), "obj_id")
    for rel in rels:
        own = edges.where(F.col("rel") == rel).select("src", "dst")
        out = out.join(own, out["obj_id"] == own["src"]).select("start", F.col("dst").alias("obj_id")).distinct()
    return out
