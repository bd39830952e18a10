"""Graphs as tables: vertices (id, type) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import graph_identifier, relation_name
from millrace.operators.dedup import _cut, few, first_of_equal


def add_triplets(nodes: DataFrame, edges: DataFrame, triplets: DataFrame, plain_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Adds what isn't there of (subj, obj, rel); relation names are upper-cased with underscores."""
    own = triplets
    if plain_ids:
        own = own.withColumns({"subj": graph_identifier(F.col("subj")), "obj": graph_identifier(F.col("obj"))})
    ends = own.select(F.col("subj").alias("id")).union(own.select(F.col("obj").alias("id"))).distinct().join(nodes, "id", "left_anti")
    missing = [F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c != "id"]
    new = own.select(F.col("subj").alias("src"), F.col("obj").alias("dst"), relation_name(F.col("rel")).alias("type")).distinct()
    new = new.join(edges, ["src", "dst", "type"], "left_anti")
    return nodes.unionByName(ends.select("id", *missing)), edges.select("src", "dst", "type").unionByName(new)


def delete_triplet(nodes: DataFrame, edges: DataFrame, subj: str, obj: str, rel: str) -> tuple[DataFrame, DataFrame]:
    """Without the edge, and without its ends if no edge is left at them. The relation's name is brought to the stored form first."""
    gone = (F.col("src") == subj) & (F.col("dst") == obj) & (F.col("type") == relation_name(F.lit(rel)))
    left = edges.where(~gone)
    lonely = orphans(nodes.where(F.col("id").isin(subj, obj)), left).select("id")
    return nodes.join(lonely, "id", "left_anti"), left


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def triplets(edges: DataFrame, subj: str | None = None, obj: str | None = None, rel: str | None = None) -> DataFrame:
    """Edges by any of subject, object and relation."""
    for column, value in (("src", subj), ("dst", obj), ("type", rel)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def flattened(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (first of each id and type, in order of ``idx``) and edges of rows that hold arrays ``nodes`` and ``relationships``."""
    nodes = elements.select("idx", F.posexplode("nodes").alias("p", "n")).select("idx", "p", "n.id", "n.type")
    nodes = first_of_equal(nodes.withColumn("o", F.struct("idx", "p")), ["id", "type"], "o").select("id", "type")
    edges = elements.select(F.explode("relationships").alias("r")).select(F.col("r.subj").alias("src"), F.col("r.obj").alias("dst"), F.col("r.type").alias("type")).distinct()
    return nodes, edges


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    known = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return known.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``degree``, ``centrality`` = degree / (n - 1); 1 for a graph of one node."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select("id").join(ends, "id", "left").crossJoin(F.broadcast(n)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.select("id", "degree", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def property_schema(elements: DataFrame, label: str = "type", properties: str = "properties") -> DataFrame:
    """``label``, ``property``: which properties occur with each label, of a map column."""
    return elements.select(F.col(label).alias("label"), F.explode(F.map_keys(properties)).alias("property")).distinct()


def shortest_path(edges: DataFrame, source, target, directed: bool = False, weight: str | None = None) -> DataFrame:
    """One row: ``found``, ``length``, ``path`` (an array of ids), ``message``.

    Distances are relaxed round by round from the source, each written off at once; a round joins the nodes that changed with the edges.
    Rounds end when nothing changes, or without weights when the target is reached. Weights that
    fall without end (a cycle below 0) raise.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    if not directed:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    e = e.groupBy("src", "dst").agg(F.min("w").alias("w"))
    kind = dict(edges.dtypes)["src"]
    spark = edges.sparkSession
    best = _cut(spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0.0).alias("d"), F.array(F.lit(source).cast(kind)).alias("path")))
    front = best
    rounds, most = 0, e.select("src").union(e.select("dst")).distinct().count() + 1
    while True:
        rounds += 1
        if rounds > most:
            raise ValueError("a cycle has a negative weight")
        steps = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"), F.concat("path", F.array("dst")).alias("path"))
        steps = steps.groupBy("id").agg(F.min(F.struct("d", "path")).alias("m")).select("id", "m.d", "m.path")
        old = best.select("id", F.col("d").alias("o"))
        front = _cut(steps.join(old, "id", "left").where("o IS NULL OR d < o").select("id", "d", "path"))
        if front.isEmpty():
            break
        best = _cut(best.join(front.select("id"), "id", "left_anti").union(front))
        if weight is None and not front.where(F.col("id") == F.lit(target).cast(kind)).isEmpty():
            break
    hit = best.where(F.col("id") == F.lit(target).cast(kind)).agg(F.max("d").alias("length"), F.first("path").alias("path"))
    return hit.select(F.col("length").isNotNull().alias("found"), "length", "path", F.when(F.col("length").isNull(), F.lit(f"No path exists between '{source}' and '{target}'")).alias("message"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as one JSON text; meant for graphs that a reader wants whole."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id"))).alias("nodes"))
    m = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type"))).alias("links"))
    return n.crossJoin(m).select(F.to_json(F.struct("nodes", "links")).alias("graph"))


def keyword_neighbours(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, properties: list[str], k: int = 5) -> DataFrame:
    """For each of a bounded table of ``keyword``s (its size is checked), edges at nodes one of whose properties contains it; k each, by (src, dst, type)."""
    from pyspark.sql import Window

    any_hit = F.lit(False)
    for p in properties:
        any_hit |= F.coalesce(F.col(p).cast("string").contains(F.col("keyword")), F.lit(False))
    hits = nodes.join(few(keywords), how="cross").where(any_hit).select("keyword", "id")
    both = edges.select(F.col("src").alias("id"), "src", "dst", "type").union(edges.select(F.col("dst").alias("id"), "src", "dst", "type"))
    found = hits.join(both, "id").select("keyword", "src", "dst", "type").distinct()
    return found.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy("src", "dst", "type"))).where(F.col("n") <= k).drop("n")


def label_quotas(nodes: DataFrame, label: str, wanted: int) -> DataFrame:
    """``label``, ``quota``: the labels' shares of ``wanted`` nodes, whole numbers within one of the exact shares (largest remainders first, then the label)."""
    from pyspark.sql import Window

    by = nodes.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each label
    own = by.select("label", F.floor(F.lit(wanted) * F.col("n") / total).alias("low"), F.pmod(F.lit(wanted) * F.col("n"), total).alias("rest"))
    place = F.row_number().over(Window.orderBy(F.col("rest").desc(), F.col("label").asc_nulls_last()))
    left = F.lit(wanted) - F.sum("low").over(Window.partitionBy())
    return own.select("label", (F.col("low") + (place <= left).cast("int")).cast("long").alias("quota"))


#: Walkers that are sent to the graph's tasks; more are shuffled with it.
WALKERS = 100_000


def _drawn(*by) -> Column:
    """A number from 0 up to, but not, 1 that follows from the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*by), 12) / float(1 << 52)


def _wheels(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a draw of an edge by its weight looks up, whatever the degree: ``src``, ``wheel`` (its parts, each a span of the node's weight), and the edges of each part by slot.

    A part of m edges has m slots of equal width, and an edge stands in all that its span meets: 2 m rows at most, of which a draw meets two on average.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("src", "part").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    spans = e.withColumn("hi", F.sum(F.greatest(F.col("pull"), F.lit(1e-6))).over(own))
    spans = _cut(spans.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy("src", "part").orderBy("dst")), F.lit(0.0))).select("src", "part", "dst", "lo", "hi"))
    whole = _cut(spans.groupBy("src", "part").agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("m")))
    slot = lambda x: F.least(F.floor(F.col(x) / F.col("total") * F.col("m")), F.col("m") - 1)
    slots = spans.join(whole, ["src", "part"]).select("src", "part", "dst", "lo", "hi", F.explode(F.sequence(slot("lo"), slot("hi"))).alias("slot"))
    upto = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    turned = whole.withColumn("end", F.sum("total").over(upto))
    wheel = turned.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("end", "part", "total", "m"))).alias("wheel"))
    return _cut(wheel), _cut(slots.where("hi > lo"))


def walk_sample(nodes: DataFrame, edges: DataFrame, starts: list, ratio: float, restart: float = 0.1, seed: int = 0, doubling: int = 4, neighbour_aware: bool = False, label: str | None = None, weight: str | None = None, hub: int = 10_000) -> DataFrame:
    """Ids met by seeded random walks with restarts until a share of the nodes is met, or all that can be reached.

    A walker stands at each start. Each round it goes back to its start with the chance ``restart``, else to a neighbour: the winner of a seeded race, in which an edge is the faster the
    larger its ``weight`` (a column of ``edges``; null and negative count as 0, which is never taken if another can be), times, if aware of common neighbours, the share of the neighbour's neighbours that the two haven't in common.
    Nodes of more than ``hub`` edges are split into parts that race on their own before the parts' winners do. If not aware of common neighbours, a race is decided by one draw
    from the node's summed weights, with the same chances, so that a step costs a walker two rows and not all edges of its node.
    After each ``doubling`` rounds there are twice as many walkers at each start, so rounds grow with the logarithm of the number wanted.

    ``label``: a column of ``nodes`` by which the sample is stratified. Each label has a quota, its share of the wanted number; the walks go on until every quota is met by the first
    nodes of its label that they came to, or all reachable ones.
    """
    from pyspark.sql import Window

    spark = nodes.sparkSession
    kind = dict(nodes.dtypes)["id"]
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    both = edges.select("src", "dst", own.alias("pull")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), own.alias("pull")))
    e = both.groupBy("src", "dst").agg(F.sum("pull").alias("pull") if weight else F.lit(1.0).alias("pull"))
    degree = _cut(e.groupBy("src").agg(F.count(F.lit(1)).alias("k")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("k") / hub)).cast("int")
    e = _cut(e.join(degree, "src").select("src", "dst", "pull", F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part"), parts.alias("parts")))
    wanted = int(nodes.count() * ratio)
    labelled = _cut(nodes.select("id", (F.col(label) if label else F.lit(None).cast("string")).alias("label")).dropDuplicates(["id"]))
    quotas = label_quotas(nodes, label, wanted) if label else spark.createDataFrame([(None, wanted)], "label string, quota long")
    quotas = _cut(quotas)

    def short(found: DataFrame) -> DataFrame:
        """The labels whose quota the found ids don't fill, with how many there are."""
        have = found.select("id").join(labelled, "id").groupBy("label").agg(F.count(F.lit(1)).alias("have"))
        have = have.select(F.col("label").alias("_l"), "have")
        each = quotas.join(have, F.col("label").eqNullSafe(F.col("_l")), "left").select("label", "quota", F.coalesce("have", F.lit(0)).alias("have"))
        return each.where("have < quota")

    at = spark.createDataFrame([(i, s, s) for i, s in enumerate(starts)], f"walker int, start {kind}, id {kind}")
    met = _cut(at.groupBy("id").agg(F.lit(-1).alias("step")))
    reach = front = _cut(met.select("id"))
    while not front.isEmpty() and not short(reach).isEmpty():
        front = _cut(e.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(reach, "id", "left_anti"))
        reach = _cut(reach.union(front))
    lacking = short(reach).select(F.col("label").alias("_l"), F.col("have").alias("most"))
    quotas = _cut(quotas.join(lacking, F.col("label").eqNullSafe(F.col("_l")), "left").select("label", F.coalesce("most", "quota").alias("quota")))
    if not neighbour_aware:
        wheels, slots = _wheels(e)
        at = _cut(at.join(wheels.select(F.col("src").alias("id")), "id", "left_semi").select("walker", "start", "id"))  # a start without an edge has been met

    def race(at: DataFrame, step: int) -> DataFrame:
        """Where each walker goes: all edges of its node are compared."""
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "walker"), F.lit(1_000_000)) / 1e6
        move = at.withColumn("back", chance < restart)
        draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "walker", "dst"), F.lit(1_000_000)) + 1) / 1e6
        dealt = move.join(degree.select(F.col("src").alias("id"), parts.alias("parts")), "id", "left")
        dealt = dealt.select("walker", "start", "id", "back", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = dealt.join(e.select(F.col("src").alias("id"), "dst", "pull", "part"), ["id", "part"], "left")
        # Neighbours in common are counted for the walkers' own moves only, never for all pairs of nodes.
        steps = near.select("walker", "id", "dst").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("third")), "dst")
        shared = steps.join(e.select(F.col("src").alias("id"), F.col("dst").alias("third")), ["id", "third"], "left_semi").groupBy("walker", "dst").agg(F.count(F.lit(1)).alias("c"))
        near = near.join(shared, ["walker", "dst"], "left").join(degree.withColumnRenamed("src", "dst"), "dst", "left").withColumn("w", F.col("pull") * (1 - F.coalesce("c", F.lit(0)) / F.coalesce("k", F.lit(1))))
        won = -F.log(draw) / F.greatest(F.col("w"), F.lit(1e-6))
        first = near.groupBy("walker", "start", "back", "part").agg(F.min_by(F.struct("dst", won.alias("t")), won).alias("b"))
        next_ = first.groupBy("walker", "start", "back").agg(F.min_by("b.dst", "b.t").alias("dst"))
        return _cut(next_.select("walker", "start", F.when(F.col("back") | F.col("dst").isNull(), F.col("start")).otherwise(F.col("dst")).alias("id")))

    def draw(at: DataFrame, step: int) -> DataFrame:
        """The same by two draws: of the part, and of the edge in it. Every walker finds one row of each table, which stay where they are while the walkers are few."""
        sent = F.broadcast if len(starts) << max(0, step // doubling) <= WALKERS else (lambda rows: rows)
        drawn = lambda what: _drawn(F.lit(seed), F.lit(step), F.col("walker"), F.lit(what))
        move = wheels.withColumnRenamed("src", "id").join(sent(at.withColumn("back", drawn("back") < restart)), "id")
        place = drawn("part") * F.element_at("wheel", -1)["end"]
        move = move.withColumn("p", F.filter("wheel", lambda x: x["end"] > place)[0])
        move = move.withColumn("x", drawn("edge") * F.col("p.total"))
        move = move.select("walker", "start", "back", "trail", "id", F.col("p.part").alias("part"), "x", F.least(F.floor(F.col("x") / F.col("p.total") * F.col("p.m")), F.col("p.m") - 1).alias("slot"))
        a, b = sent(move).alias("a"), slots.alias("b")
        on = (F.col("a.id") == F.col("b.src")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("b.lo") <= F.col("a.x")) & (F.col("a.x") < F.col("b.hi"))
        to = F.when(F.col("a.back"), F.col("a.start")).otherwise(F.col("b.dst"))
        return b.join(a, on).select("a.walker", "a.start", to.alias("id"), F.concat("a.trail", F.array(F.struct(F.lit(step).alias("step"), to.alias("id")))).alias("trail"))

    step = -1
    while not short(met).isEmpty():
        # The rounds between two doublings are one plan; what an unlabelled sample has too much of then is taken off.
        many = 1 if neighbour_aware else doubling
        if step >= 0 and (step + 1) % doubling == 0:
            count = len(starts) << ((step + 1) // doubling - 1)
            at = _cut(at.union(at.select((F.col("walker") + count).cast("int").alias("walker"), "start", "id")))
        if neighbour_aware:
            at = race(at, step + 1)
            new = at.select("id", F.lit(step + 1).alias("step"))
        else:
            moved = at.withColumn("trail", F.array().cast(f"array<struct<step: int, id: {kind}>>"))
            for i in range(many):
                moved = draw(moved, step + 1 + i)
            moved = _cut(moved)
            at, new = moved.drop("trail"), moved.select(F.explode("trail").alias("t")).select("t.id", "t.step")
        step += many
        met = _cut(met.union(new).groupBy("id").agg(F.min("step").alias("step")))
    if not label and not neighbour_aware:
        quota = quotas.first()["quota"]
        total, last = 0, -1
        for row in met.join(labelled, "id").groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect():  # a row for each round
            total, last = total + row.n, row.step
            if total >= quota:
                break
        met = met.where(F.col("step") <= last)
    if not label:
        return met.select("id")
    place = F.row_number().over(Window.partitionBy("label").orderBy("step", F.xxhash64(F.lit(seed), "id"), "id"))
    first = met.join(labelled, "id").withColumn("n", place)
    kept = first.join(quotas.withColumnRenamed("label", "_l"), F.col("label").eqNullSafe(F.col("_l"))).where(F.col("n") <= F.col("quota"))
    return kept.select("id", "label")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = True) -> None:
    """The graph as a folder of JSON lines in node-link form: ``nodes`` (``id`` and what else a node has), ``links`` (``source``, ``target`` and what else an edge has) and ``graph``, its flags with both schemas.

    Each part is written by the tasks that hold its rows; there is no row or task of the whole graph. The flags come last, so a folder without them is no graph.
    """
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])
    nodes.write.option("ignoreNullFields", False).json(f"{path}/nodes")
    links.write.option("ignoreNullFields", False).json(f"{path}/links")
    head = [(directed, True, nodes.schema.json(), links.schema.json())]
    nodes.sparkSession.createDataFrame(head, "directed boolean, multigraph boolean, nodes string, links string").coalesce(1).write.json(f"{path}/graph")


def read_node_link(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (``src``, ``dst``, ...) of a folder that ``write_node_link`` wrote, with the types they had."""
    import json

    from pyspark.sql import types as T

    head = spark.read.schema("directed boolean, nodes string, links string").json(f"{path}/graph").first()
    read = lambda part, schema: spark.read.schema(T.StructType.fromJson(json.loads(schema))).json(f"{path}/{part}")
    links = read("links", head.links)
    return read("nodes", head.nodes), links.select(F.col("source").alias("src"), F.col("target").alias("dst"), *[c for c in links.columns if c not in ("source", "target")])


def register_views(nodes: DataFrame, edges: DataFrame, prefix: str = "") -> None:
    """Views ``vertices`` and ``edges`` for queries in SQL."""
    nodes.createOrReplaceTempView(f"{prefix}vertices")
    edges.createOrReplaceTempView(f"{prefix}edges")
