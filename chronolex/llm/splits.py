"""Splits that keep related records together: problem 3.

Records sharing any entity belong together. The entities of a record form a star of edges, made
distinct before anything else, so the graph has the size of the distinct entity combinations
and not of the rows. Alternating large-star and small-star passes turn each component into a
star around its smallest entity; every pass takes minima with map-side combining, so an entity
of a third of all records is one edge list like any other. Components are then hashed into
proportional ranges.

A component larger than half of the smallest side cannot be left to chance: there are at most
2 / (smallest share) such, and they are placed one by one, largest first, where most is missing.
The ranges of the others make up for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.shared import materialise, release

UNIT = 1 << 30
#: Nodes of more edges than HUB are spread over SALTS join keys.
HUB, SALTS = 1_000_000, 64


def _stars(edges: DataFrame, large: bool, hubs: bool = True) -> DataFrame:
    """One large-star or small-star pass over (u, v), u > v or in any order.

    With ``hubs`` the join that gives a node's neighbours its minimum is on (node, salt): the minimum of a
    hub is copied to every salt, so its neighbours are as many tasks as salts.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        out = _salted(both, low, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        x = _salted(down, low, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = x.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _salted(edges: DataFrame, low: DataFrame, hubs: bool) -> DataFrame:
    """``edges`` with m of their u; a u of more than ``HUB`` edges meets on ``SALTS`` keys, others on one."""
    if not hubs:
        return edges.join(low.select("u", "m"), "u")
    hub = F.col("n") > HUB
    m = low.select("u", "m", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"))
    x = edges.join(low.where(hub).select(F.col("u").alias("__hub")), F.col("u") == F.col("__hub"), "left")
    x = x.withColumn("salt", F.when(F.col("__hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(-1)).drop("__hub")
    return x.join(m, ["u", "salt"])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph (u string, v string); the component is its smallest node.

    Nodes of self-loops only come out as their own component.
    """
    edges = materialise(edges.select(F.col("u").cast("string"), F.col("v").cast("string")).distinct(), "edges")
    now, mark = edges.where("u <> v"), None
    hubs = edges.count() > HUB  # with fewer edges no node has so many; the passes add none
    for _ in range(rounds):
        large = materialise(_stars(now, True, hubs), "large")
        was, before = mark, now
        now = materialise(_stars(large, False, hubs), "small")
        mark = _mark(now)
        release(large, before)
        if mark == was:
            break
    else:
        raise RuntimeError(f"the graph did not settle in {rounds} rounds")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def with_components(df: DataFrame, entities: list[Column], name: str = "component", extra: list[str] | None = None) -> DataFrame:
    """``df`` with the component of each record; records without any entity get null.

    An entity is a string; the same string in two columns is the same entity, a null none.
    """
    ents = F.array_compact(F.array(*(e.cast("string") for e in entities)))
    x = df.withColumn("__entities", ents).withColumn("__first", F.try_element_at("__entities", F.lit(1)))
    combos = x.select(F.array_sort(F.array_distinct("__entities")).alias("e")).where("size(e) > 0").distinct()
    edges = combos.select(F.explode("e").alias("u"), F.col("e")[0].alias("v"))
    comp = components(edges).select(F.col("node").alias("__node"), F.col("component").alias(name))
    return x.join(comp, F.col("__first") == F.col("__node"), "left").drop("__entities", "__first", "__node")


def assign_sides(sized: DataFrame, targets: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """(component, side) from (component, n): whole components in the shares of ``targets``.

    At most 2 / (smallest share) components are seen by the driver, those that are too large
    for hashing; the others go by their hash alone.
    """
    targets = [(s, float(t)) for s, t in targets if t and t > 0]
    if not targets:
        raise ValueError("no side has a share")
    whole = sum(t for _, t in targets)
    total = sized.agg(F.sum("n")).first()[0] or 0
    least = min(t for _, t in targets) / whole * total / 2
    giants = sized.where(F.col("n") > least).orderBy(F.col("n").desc(), "component").collect()
    missing = {s: t / whole * total for s, t in targets}
    placed = []
    for g in giants:
        side = max(missing, key=lambda s: (missing[s], s))
        missing[side] -= g["n"]
        placed.append((g["component"], side))
    rest = {s: max(0.0, m) for s, m in missing.items()}
    room = sum(rest.values()) or 1.0
    point = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(UNIT)) / UNIT
    side, upto = F.lit(None).cast("string"), 0.0
    cuts = []
    for s, _ in targets:
        upto += rest[s] / room
        cuts.append((s, upto))
    last = max(targets, key=lambda t: t[1])[0]
    for s, cut in reversed(cuts):
        side = F.when(point < cut, s).otherwise(side)
    x = sized.select("component", F.coalesce(side, F.lit(last)).alias("side"))
    if not placed:
        return x
    fixed = sized.sparkSession.createDataFrame(placed, "component string, fixed string")
    return x.join(F.broadcast(fixed), "component", "left").select("component", F.coalesce("fixed", "side").alias("side"))


def split_related(df: DataFrame, entities: list[Column], targets: list[tuple[str, float]], seed: int = 0, component: str = "component", side: str = "side") -> DataFrame:
    """``df`` with columns ``component`` and ``side``: records sharing an entity are on one side.

    Every row comes out once, repeated rows as often as they occur, all other columns unchanged.
    A record without any entity is related to nothing: its component is null and its side goes by
    a hash of the whole row, so repeated rows stay together. An empty table gives an empty result.
    The names of the two new columns must not clash with those of ``df``: that raises ValueError.
    """
    if {component, side} & set(df.columns):
        raise ValueError(f"the table has a column {component} or {side}; name the new ones otherwise")
    names = df.columns
    x = with_components(df, entities, component)
    key = F.coalesce(F.col(component), F.concat(F.lit("row:"), F.xxhash64(*names).cast("string")))
    x = materialise(x.withColumn("__key", key), "records")
    sized = x.groupBy(F.col("__key").alias("component")).agg(F.count("*").alias("n"))
    sides = assign_sides(sized, targets, seed).select(F.col("component").alias("__c"), F.col("side").alias(side))
    return x.join(sides, F.col("__key") == F.col("__c")).select(*names, component, side)
