"""Stored vector indexes: inverted lists whose files a search prunes, and a graph of nearest neighbours that it walks.

``VectorLists`` writes vectors into a folder for each list, that of the nearest centroid. There are as many lists as the root of the number of rows when they were
fitted (on a bounded sample: SAMPLE vectors for each list, MOST_SAMPLED at most); every vector is in one. A search reads the files of the lists
nearest its queries and of no other. Batches are added under the log of versions; ``refit`` deals all rows anew when they have outgrown
their lists. How many lists a search must probe depends on how clustered the data are: ``probes_for`` finds it from true neighbours of a
sample of rows, and keeps it with the index.

``NeighbourGraph`` holds for every vector its nearest others: first those in the cells of its two nearest pivots, then, in rounds until hardly an edge changes, the members of each cell
meet all neighbours that any of them has. Near nodes share neighbours, so a cell fetches a vector once for all its members, and sends back each node's best only. A search starts at ENTRIES times the root of the number of nodes (groups of near vectors may have no edge to others) and walks all queries at once: each round follows the edges of the best nodes not yet followed,
until each query's beam has been. Only the beams are kept: what has fallen out of one would fall out again.

Scores are cosines; 0 for zero vectors. Null vectors aren't indexed, rows without an id neither in the graph. Vectors of another length than the first raise. Ties go to
the smaller id. Searches of an empty index are empty.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import cosine_or_zero, doubles, normalised
from millrace.operators.dedup import _cut, _folder
from millrace.sources.segments import SegmentStore
from millrace.sources.versions import Files, Log

#: Sampled vectors for each list, and at most; lists at most; rows of a list and queries that one task multiplies.
SAMPLE, MOST_SAMPLED, MOST_LISTS, ROWS, QUERIES = 64, 100_000, 8192, 8192, 2048
#: Neighbours of a node, rounds at most, share of edges whose change is worth another round; rows of a cell on average and at most, and pivots at most; nodes that a search starts from, times the root of their number, and their bytes at most.
DEGREE, ROUNDS, STILL, CELL, MOST_CELL, PIVOTS, ENTRIES, ENTRY_BYTES = 24, 12, 0.002, 256, 2048, 4096, 4, 8 << 20
_HITS = "query_id long, id long, score double, list int"


def _unit(vs: pa.Array, width: int | None = None) -> np.ndarray:
    vs = vs.combine_chunks() if isinstance(vs, pa.ChunkedArray) else vs
    x = vs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(np.asarray(vs.offsets))
    width = width or (int(lengths[0]) if len(lengths) else 0)
    if (lengths != width).any():
        raise ValueError(f"vectors must have {width} components")
    x = x.reshape(len(vs), width)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


class VectorLists:
    """The index at ``path``; ``VectorLists(spark, path)`` opens it again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.files = Log(spark, f"{self.path}/log"), Files(spark)
        self.state = {"folders": {}, "rows": 0, "fitted": 0, "lists": {}, "probes": None} | self.log.read()
        self._centres = None

    @property
    def centres(self) -> np.ndarray:
        if self._centres is None:
            rows = self.spark.read.parquet(f"{self.path}/{self.state['centres']}").orderBy("list").collect()
            self._centres = np.array([r.centre for r in rows])
        return self._centres

    def fit(self, vectors: DataFrame, vector_col: str = "vector", rounds: int = 10, lists: int | None = None, seed: int = 0) -> np.ndarray:
        """Centroids from a sample: those whose hash is smallest."""
        unit = vectors.where(F.col(vector_col).isNotNull()).select(normalised(F.col(vector_col)).alias("v"))
        lists = min(MOST_LISTS, lists or max(1, math.isqrt(unit.count())))
        x = _unit(pa.array([r.v for r in unit.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(min(MOST_SAMPLED, SAMPLE * lists)).collect()], pa.list_(pa.float64())))
        centres = x[: min(lists, len(x))].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.divide(sums, length, out=centres, where=length > 1e-10)
        return centres

    def add(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", **fit) -> None:
        """Indexes a batch: all of it or, if this fails, nothing. The first one fits the centroids."""
        rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("vector"))
        if not self.state["version"]:
            if rows.isEmpty():
                return
            self._publish(rows, self.fit(vectors, vector_col, **fit), {}, {})
        else:
            self._publish(rows, None, self.state["folders"], self.state["lists"])

    def refit(self, **fit) -> None:
        """All rows in lists anew, as many as their number now asks for."""
        rows = self.rows().select("id", "vector")
        self._publish(rows, self.fit(rows, **fit), {}, {})

    def _publish(self, rows: DataFrame, centres: np.ndarray | None, folders: dict[str, list[int]], counts: dict[str, int]) -> None:
        own, change = self.centres if centres is None else centres, {}
        width = own.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = (_unit(batch.column(1), width) @ own.T).argmax(1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "vector", "list"])

        folder = f"data-{uuid.uuid4().hex}"
        if centres is not None:
            change = {"centres": f"centres-{uuid.uuid4().hex}", "probes": None}
            made = [(j, [float(x) for x in c]) for j, c in enumerate(centres)]
            self.spark.createDataFrame(made, "list int, centre array<double>").write.parquet(f"{self.path}/{change['centres']}")
        # rebalanced: a list's rows come into few files, and a large list isn't one task's
        rows.mapInArrow(assign, "id long, vector array<double>, list int").hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.path}/{folder}")
        own = self._open([f"{self.path}/{folder}"], f"{self.path}/{folder}")
        new = {str(r["list"]): r["count"] for r in own.groupBy("list").count().collect()}
        counts = {j: counts.get(j, 0) + new.get(j, 0) for j in {*counts, *new}}
        state = self.state | change | {"folders": folders | {folder: sorted(int(j) for j in new)}, "lists": counts, "rows": sum(counts.values())}
        if centres is not None:
            state["fitted"], self._centres = state["rows"], np.asarray(centres)
        self.state = state | {"version": self.log.commit(state, self.state["version"])}

    @property
    def outgrown(self) -> bool:
        """Whether the table has four times the rows that its lists were made for."""
        return self.state["rows"] > 4 * self.state["fitted"]

    def _open(self, paths: list[str], base: str) -> DataFrame:
        return self.spark.read.schema("id long, vector array<double>, list int").option("basePath", base).parquet(*paths)

    def rows(self, lists: Sequence[int] | None = None) -> DataFrame:
        """``id``, ``vector``, ``list`` of the given lists, or of all; no folders of others are listed or read."""
        wanted, out = None if lists is None else {int(j) for j in lists}, None
        for folder, own in self.state["folders"].items():
            base = f"{self.path}/{folder}"
            paths = [base] if wanted is None else [f"{base}/list={j}" for j in own if j in wanted]
            if paths:
                part = self._open(paths, base)
                out = part if out is None else out.union(part)
        return self.spark.createDataFrame([], "id long, vector array<double>, list int") if out is None else out

    def nearest_lists(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of the lists nearest each unit vector."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        return self.search_many(one, k, probes).drop("query_id")

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """``query_id``, ``id``, ``score``, ``rank``: for each query the k best rows of its nearest lists.

        Lists of more than ROWS rows, and queries of one list beyond QUERIES, are dealt into blocks that meet each other, so no task holds a whole list or all its queries.
        """
        if not self.state["rows"]:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank long")
        found = self._found(queries.select(F.col(query_id).cast("long").alias("query_id"), doubles(F.col(query_col)).alias("query")), k, probes or self.state["probes"] or max(1, len(self.centres) // 4))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return found.drop("list").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    def _found(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        centres = self.centres

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unit(batch.column(1), centres.shape[1])
                lists = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(x)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(lists.ravel().astype(np.int32))], names=["query_id", "query", "list"])

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            missing = np.zeros(0, bool)
            if left.num_rows and right.num_rows:
                none = np.iinfo(np.int64).max
                ids = left.column("id").combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
                score = np.round(_unit(right.column("query")) @ _unit(left.column("vector")).T, 12)
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                query = right.column("query_id").to_numpy()
                out = [np.repeat(query, order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, 1).ravel()]
                missing = out[1] == none
            which = left.column("list")[0].as_py() if len(out[0]) else 0
            return pa.Table.from_arrays([pa.array(out[0]), pa.array(out[1], mask=missing), pa.array(out[2]), pa.array(np.full(len(out[0]), which, np.int32))], names=["query_id", "id", "score", "list"])

        asked = _cut(queries.where("query IS NOT NULL").mapInArrow(near, "query_id long, query array<double>, list int"))
        counts = asked.groupBy("list").count().collect()  # as many rows as there are lists
        shape = [(int(r["list"]), -(-self.state["lists"].get(str(r["list"]), 0) // ROWS), -(-r["count"] // QUERIES)) for r in counts]
        shape = self.spark.createDataFrame([s for s in shape if s[1]], "list int, subs int, parts int")
        rows = self.rows([r["list"] for r in counts]).join(F.broadcast(shape), "list")
        rows = rows.select("id", "vector", "list", F.pmod(F.xxhash64("id", "vector"), "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = asked.join(F.broadcast(shape), "list").select("query_id", "query", "list", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
        on = ["list", "sub", "part"]
        return rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(best, _HITS)

    def probes_for(self, recall: float, k: int, sample: int = 200, seed: int = 1) -> int:
        """The fewest lists whose search finds that share of the k true neighbours of sampled rows; kept with the index as its default.

        The sampled rows (those of the smallest hash, ``sample`` at most) are searched for in all lists.
        """
        rows = self.rows().select(F.col("id").alias("query_id"), F.col("vector").alias("query")).where("query_id IS NOT NULL")
        asked = _cut(rows.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(sample))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        true = self._found(asked, k, len(self.centres)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query_id", "list").collect()
        own = {r.query_id: r.query for r in asked.collect()}
        ids = list(own)
        place = np.argsort(self.nearest_lists(_unit(pa.array([own[i] for i in ids], pa.list_(pa.float64()))), len(self.centres)), axis=1)
        at = dict(zip(ids, place, strict=True))
        depth = np.sort([at[r.query_id][r.list] for r in true])
        probes = int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1 if len(depth) else 1
        state = self.state | {"probes": probes}
        self.state = state | {"version": self.log.commit(state, self.state["version"])}
        return probes


class NeighbourGraph:
    """The graph at ``path``; ``NeighbourGraph(spark, path)`` opens it again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, SegmentStore(spark, path)

    def build(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 0) -> list[int]:
        """Indexes all vectors; ids must be distinct. Returns how many edges each round changed."""
        if self.store.version:
            raise FileExistsError("the graph is built already")
        rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), normalised(F.col(vector_col)).alias("vector"))
        nodes = self.store.add("nodes", rows, "id", ("id",))
        if nodes is None:
            return []
        n, width = nodes.count(), len(nodes.first()["vector"])
        if nodes.select("id").distinct().count() < n:
            raise ValueError("ids repeat")
        cells = _cut(self._cells(nodes, n, seed))
        short = nodes.select("id", F.col("vector").cast("array<float>").alias("vector"))
        edges, old = self._best(self._meeting(short, cells.select("id", "cell", "sub").distinct(), None, degree), degree)
        changed = []
        for step in range(rounds):
            own = cells.where(F.col("nth") == step % 2).select("id", "cell", "sub")
            edges, path = self._best(edges.withColumn("fresh", F.lit(False)).unionByName(self._meeting(short, own, edges, degree)), degree)
            self.store.files.delete(old)
            old = path
            changed.append(edges.where("fresh").count())
            if changed[-1] <= STILL * n * degree:
                break
        out = edges.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("near"))
        self.store.add("edges", out.withColumnRenamed("u", "id"), "id", ("id",))
        entries = nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(1, min(32 + ENTRIES * math.isqrt(n), ENTRY_BYTES // (8 * max(1, width))))).select("id", "vector")
        self.store.add("entries", entries, "id")
        self.store.commit(nodes=n, degree=degree)
        self.store.files.delete(old)
        return changed

    def _cells(self, nodes: DataFrame, n: int, seed: int) -> DataFrame:
        """``id``, ``nth`` (0, 1), ``cell``, ``sub``: the cells of each node's two nearest pivots; larger ones than MOST_CELL are dealt into parts."""
        sample = nodes.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(min(PIVOTS, -(-n // CELL))).collect()
        pivots = np.array([r["vector"] for r in sample])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, MOST_CELL):
                    part = batch.slice(start, MOST_CELL)
                    near = np.argsort(-(_unit(part.column(1)) @ pivots.T), axis=1, kind="stable")[:, :2]
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
                    nth = np.tile(np.arange(near.shape[1], dtype=np.int32), len(near))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(nth), pa.array(near.ravel().astype(np.int32))], names=["id", "nth", "cell"])

        placed = _cut(nodes.select("id", "vector").mapInArrow(place, "id long, nth int, cell int"))
        if len(pivots) == 1:
            placed = placed.union(placed.withColumn("nth", F.lit(1)))
        parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MOST_CELL).cast("int").alias("parts"))  # a row for each pivot
        return placed.join(F.broadcast(parts), "cell").select("id", "nth", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("sub"))

    def _meeting(self, nodes: DataFrame, cells: DataFrame, edges: DataFrame | None, degree: int) -> DataFrame:
        """Edges of the members (id, cell, sub) of each cell to the nearest of them and of the nodes that any of them has an edge to; and of these visitors to the nearest members."""
        few = max(4, degree // 4)

        def meet(cell: pa.Table) -> pa.Table:
            ids, inside = cell.column("id").to_numpy(), cell.column("inside").to_numpy(zero_copy_only=False)
            x = cell.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            made = [*_nearest(ids[inside], x[inside], ids, x, degree), *_nearest(ids[~inside], x[~inside], ids[inside], x[inside], few)]
            u, v, score = (np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table([pa.array(u), pa.array(v), pa.array(score.astype(np.float64)), pa.array(np.ones(len(u), bool))], names=["u", "v", "s", "fresh"])

        there = cells.withColumn("inside", F.lit(True))
        if edges is not None:
            visits = edges.join(cells.withColumnRenamed("id", "u"), "u").select(F.col("v").alias("id"), "cell", "sub", F.lit(False).alias("inside"))
            there = there.unionByName(visits).groupBy("id", "cell", "sub").agg(F.max("inside").alias("inside"))
        return there.join(nodes, "id").groupBy("cell", "sub").applyInArrow(meet, "u long, v long, s double, fresh boolean")

    def _best(self, edges: DataFrame, degree: int) -> tuple[DataFrame, str]:
        """The ``degree`` best edges of each node, written, and where."""
        order, path = Window.partitionBy("u").orderBy(F.col("s").desc(), "v"), _folder(self.spark)
        each = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))  # dealt once, by u
        each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= degree).drop("n").write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema("u long, v long, s double, fresh boolean").parquet(path), path

    def search_many(self, queries: DataFrame, k: int, beam: int = 96, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """``query_id``, ``id``, ``score``, ``rank``. ``beam``: nodes that a query keeps, and follows, at a time; at least k."""
        if not self.store.version:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank long")
        nodes, edges, entries = self.store.tables("nodes")[0], self.store.tables("edges")[0], self.store.tables("entries")[0]
        asked = _cut(queries.where(F.col(query_col).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), normalised(F.col(query_col)).alias("query")))
        score = F.round(cosine_or_zero(F.col("vector"), F.col("query")), 12).alias("score")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        beams = lambda rows: _cut(rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(beam, k)).drop("n"))
        held = beams(asked.crossJoin(F.broadcast(entries)).select("query_id", "id", score, F.lit(True).alias("open")))  # of ENTRY_BYTES at most
        # queries go to the vectors, in parts of ENTRY_BYTES, so that no vector is moved for each query that meets it
        count, width = asked.agg(F.count(F.lit(1)), F.max(F.size("query"))).first()
        parts = max(1, -(-count * 8 * (width or 1) // ENTRY_BYTES))
        part = lambda rows, i: rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        while not held.where("open").isEmpty():
            near = edges.join(held.where("open").select("query_id", "id"), "id").select("query_id", F.explode("near").alias("id")).distinct()
            near = near.join(held.select("query_id", "id"), ["query_id", "id"], "left_anti")
            near, both = near if parts == 1 else _cut(near), held.withColumn("open", F.lit(False))
            for i in range(parts):
                met = nodes.join(part(near, i), "id").join(F.broadcast(part(asked, i)), "query_id")
                both = both.union(met.select("query_id", "id", score, F.lit(True).alias("open")))
            held = beams(both)
        return held.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From each row to the ``most`` nearest others, some rows at a time."""
    most = min(most, len(others) - 1)
    for start in range(0, len(ids) if most > 0 else 0, CELL):
        own = ids[start : start + CELL]
        s = x[start : start + CELL] @ y.T
        s[own[:, None] == others[None, :]] = -2
        near = np.argpartition(-s, most - 1, axis=1)[:, :most]
        u, v, score = np.repeat(own, most), others[near].ravel(), np.take_along_axis(s, near, 1).ravel()
        yield u[u != v], v[u != v], score[u != v]
