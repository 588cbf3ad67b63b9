"""Property graphs on two DataFrames: vertices (id, ...) and edges (src, dst, rtype, weight).

Breadth-first traversals of graphs beyond a counted number of edges are loops of joins over the frontier; each step's frontier is
checkpointed where the session has a checkpoint folder. A depth-first order has no parallel form where vertices may be visited once only: the edges that can be
reached are found by joins, then one task walks them, up to a counted bound. The start has depth 1, depths are
inclusive. Siblings are ordered by neighbour, then type.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.cache()


def steps(edges: DataFrame, expander: str = "OUTGOING", rtype: str | None = None) -> DataFrame:
    """(here, there, rtype, weight, arrow) by direction: OUTGOING, INCOMING or BOTH."""
    e = edges if rtype is None else edges.where(F.col("rtype") == rtype)
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("double")
    out = e.select(F.col("src").alias("here"), F.col("dst").alias("there"), "rtype", weight.alias("weight"), F.concat(F.lit("-["), "rtype", F.lit("]->")).alias("arrow"))
    back = e.select(F.col("dst").alias("here"), F.col("src").alias("there"), "rtype", weight.alias("weight"), F.concat(F.lit("<-["), "rtype", F.lit("]-")).alias("arrow"))
    return {"OUTGOING": out, "INCOMING": back, "BOTH": out.unionByName(back)}[expander]


def _merged(hop: DataFrame, many: bool) -> DataFrame:
    """Steps for a loop of joins: of many edges none go through the driver, which a broadcast would send there again in each round."""
    return hop.hint("merge") if many else hop


def _vertices(hop: DataFrame) -> int:
    return hop.select(F.col("here").alias("id")).union(hop.select("there")).distinct().count()


def bfs(edges: DataFrame, start, expander: str = "OUTGOING", rtype: str | None = None, min_depth: int = 1, max_depth: int | None = None, uniqueness: str = "NODE_GLOBAL", emit=None, expand=None, one_task: int = 200_000) -> DataFrame:
    """(id, depth, path) in breadth-first order. uniqueness: NODE_GLOBAL, PATH_GLOBAL (parent, type, node) or NONE.

    max_depth: None goes on to the end; under NONE a cycle has no end, which is an error.
    emit, expand: conditions over (id, depth) for rows to return and to go on from; a row may be returned and not expanded.
    one_task: up to so many edges, counted first, one task goes from vertex to vertex if each counts once and all are expanded.
    More are joined by merging in every case.
    """
    spark = edges.sparkSession
    hop = steps(edges, expander, rtype)
    many = hop.count() > one_task
    if uniqueness == "NODE_GLOBAL" and expand is None and one_task and not many:

        def walk(near):
            level, seen, depth = {start: str(start)}, {start}, 1
            while level and (max_depth is None or depth <= max_depth):
                yield from ((x, depth, path) for x, path in level.items() if depth >= min_depth)
                new: dict = {}
                for here, path in level.items():
                    for there, _, _, arrow in near.get(here, []):
                        if there not in seen:
                            way = f"{path}{arrow}{there}"
                            if there not in new or way.encode() < new[there].encode():
                                new[there] = way
                seen.update(new)
                level, depth = new, depth + 1

        out = _in_one_task(hop, f"id {dict(edges.dtypes)['src']}, depth int, path string", walk)
        return (out if emit is None else out.where(emit)).orderBy("depth", "path")
    front = spark.createDataFrame([(start,)], f"id {dict(edges.dtypes)['src']}").select("id", F.lit(1).alias("depth"), F.col("id").cast("string").alias("path"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent"), F.lit("").alias("rtype"))
    seen = front
    # Without uniqueness, a path of more vertices than there are has been through a cycle.
    bound = _vertices(hop) if max_depth is None and uniqueness == "NONE" else None
    hop = _merged(hop, many)
    for depth in count(2) if max_depth is None else range(2, max_depth + 1):
        base = front if expand is None else front.where(expand)
        new = base.select(F.col("id").alias("here"), F.col("path").alias("before")).join(hop, "here").select(F.col("there").alias("id"), F.lit(depth).alias("depth"), F.concat("before", "arrow", F.col("there").cast("string")).alias("path"), F.col("here").alias("parent"), "rtype")
        if uniqueness != "NONE":
            by = ["id"] if uniqueness == "NODE_GLOBAL" else ["parent", "rtype", "id"]
            new = new.groupBy(*by).agg(F.min(F.struct("path", "depth", *[c for c in ("parent", "rtype") if c not in by])).alias("m")).select(*by, "m.*").select("id", "depth", "path", "parent", "rtype").join(_merged(seen.select(*by), many), by, "left_anti").select("id", "depth", "path", "parent", "rtype")
        front = _cut(new)
        if front.isEmpty():
            break
        if bound is not None and depth > bound:
            raise ValueError("a cycle has no end without uniqueness or max_depth")
        seen = seen.unionByName(front)
        seen = seen if depth % 50 else _cut(seen)
    out = seen.where(F.col("depth") >= min_depth)
    return (out if emit is None else out.where(emit)).select("id", "depth", "path").orderBy("depth", "path")


#: Edges that one task may hold: some hundred MB. More are walked by joins where that is possible.
ONE_TASK = 2_000_000


def _in_one_task(hop: DataFrame, schema: str, walk: Callable) -> DataFrame:
    """Rows that ``walk`` makes of the neighbours {here: [(there, rtype, weight, arrow), ..]}, sorted by neighbour and type."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        import pyarrow as pa

        near: dict = {}
        for batch in batches:
            for here, *step in zip(*(batch.column(c).to_pylist() for c in range(5))):
                near.setdefault(here, []).append(tuple(step))
        for steps_of in near.values():
            steps_of.sort(key=lambda s: (s[0], s[1] or ""))
        rows = list(walk(near))
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], kinds[schema.split(", ")[k].split()[1]]) for k, n in enumerate(names)})

    return hop.select("here", "there", "rtype", "weight", "arrow").coalesce(1).mapInArrow(work, schema)


def dfs(edges: DataFrame, start, expander: str = "OUTGOING", rtype: str | None = None, min_depth: int = 1, max_depth: int | None = None, uniqueness: str = "NODE_GLOBAL", emit: Callable | None = None, expand: Callable | None = None) -> DataFrame:
    """(id, depth, path, place) in depth-first order, ``place`` counting from 0: the walk goes on from a vertex before its siblings.

    emit, expand: Python functions of (id, depth). Of a larger graph the edges within reach are found by :func:`bfs` first and
    must not be more than ``ONE_TASK``; more are an error, never a part of the answer.
    """
    hop = steps(edges, expander, rtype)
    # Without uniqueness and without an end this fails on a cycle.
    reach = "NONE" if uniqueness == "NONE" and expand is None else "NODE_GLOBAL"
    if hop.count() > ONE_TASK or reach == "NONE":
        found = _cut(bfs(edges, start, expander, rtype, max_depth=max_depth, uniqueness=reach).select(F.col("id").alias("here")).distinct())
        hop = _cut(hop.join(found, "here", "left_semi").select("here", "there", "rtype", "weight", "arrow"))
        if (n := hop.count()) > ONE_TASK:
            raise ValueError(f"{n} edges are too many for a depth-first order")
    vertices = None if uniqueness != "NONE" or max_depth is not None else _vertices(hop)

    def walk(near):
        seen, todo, place = set(), [(start, 1, str(start), None, "")], 0
        while todo:
            here, depth, path, parent, kind = todo.pop()
            mark = {"NODE_GLOBAL": here, "PATH_GLOBAL": (parent, kind, here)}.get(uniqueness)
            if uniqueness != "NONE":
                if mark in seen:
                    continue
                seen.add(mark)
            if vertices is not None and depth > vertices + 1:
                raise ValueError("a cycle has no end without uniqueness or max_depth")
            if depth >= min_depth and (emit is None or emit(here, depth)):
                yield here, depth, path, place
                place += 1
            if (max_depth is None or depth < max_depth) and (expand is None or expand(here, depth)):
                todo += [(there, depth + 1, f"{path}{arrow}{there}", here, kind) for there, kind, _, arrow in reversed(near.get(here, []))]

    kind = dict(edges.dtypes)["src"]
    return _in_one_task(hop, f"id {kind}, depth int, path string, place long", walk).orderBy("place")


def shortest_path(edges: DataFrame, start, end, expander: str = "OUTGOING", rtype: str | None = None, max_hops: int | None = None, one_task: int = 200_000) -> DataFrame:
    """(id, cost, path) of the cheapest way by ``weight`` (a missing one is infinite: no way).

    Up to ``one_task`` edges, counted first and without negative costs, one task walks them by cost (Dijkstra). More of
    them are relaxed by joins until no distance falls; an error if they still fall after as many hops as there are
    vertices (a cycle of negative cost) or after ``max_hops``.
    """
    spark = edges.sparkSession
    hop = steps(edges, expander, rtype).where("weight is not null")
    kind = dict(edges.dtypes)["src"]
    n, least = hop.agg(F.count("*"), F.min("weight")).first()
    if max_hops is None and n <= one_task and (least is None or least >= 0):

        def walk(near):
            todo, done = [(0.0, str(start), start)], set()
            while todo:
                cost, path, here = heapq.heappop(todo)
                if here == end:
                    yield here, cost, path
                    return
                if here not in done:
                    done.add(here)
                    for there, _, weight, arrow in near.get(here, []):
                        if there not in done:
                            heapq.heappush(todo, (cost + weight, f"{path}{arrow}{there}", there))

        return _in_one_task(hop, f"id {kind}, cost double, path string", walk)
    best = spark.createDataFrame([(start,)], f"id {kind}").select("id", F.lit(0.0).alias("cost"), F.col("id").cast("string").alias("path"))
    front = best
    bound = _vertices(hop) if max_hops is None else max_hops
    hop, many = _merged(hop, n > one_task), n > one_task
    for hops in count(1):
        new = front.join(hop, F.col("id") == F.col("here")).groupBy("there").agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", "arrow", F.col("there").cast("string")).alias("path"))).alias("m")).select(F.col("there").alias("id"), "m.cost", "m.path")
        old = best.groupBy("id").agg(F.min("cost").alias("old"))
        front = _cut(new.join(_merged(old, many), "id", "left").where("old is null or cost < old").drop("old"))
        if front.isEmpty():
            break
        if hops > bound:
            raise ValueError(f"distances still fall after {bound} hops")
        # Fronts pile up and are merged from time to time, so a hop costs one job.
        best = best.unionByName(front)
        if hops % 8 == 0:
            best = _cut(best.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("m")).select("id", "m.cost", "m.path"))
    return best.where(F.col("id") == end).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("m")).select("id", "m.cost", "m.path")


def friends_of_friends(edges: DataFrame, rtype: str) -> DataFrame:
    """(id, fof): who is two steps away over ``rtype`` and no direct friend."""
    e = edges.where(F.col("rtype") == rtype).select("src", "dst").distinct()
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).where("src <> dst").distinct()
    return two.join(e, ["src", "dst"], "left_anti").toDF("id", "fof")


def friends(edges: DataFrame, rtype: str) -> DataFrame:
    return edges.where(F.col("rtype") == rtype).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("friends"))


def add_vertex(vertices: DataFrame, new: DataFrame) -> DataFrame:
    return vertices.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_vertex(vertices: DataFrame, edges: DataFrame, ids: list) -> tuple[DataFrame, DataFrame]:
    return vertices.where(~F.col("id").isin(ids)), edges.where(~F.col("src").isin(ids) & ~F.col("dst").isin(ids))


def delete_edge(edges: DataFrame, src, rtype: str, dst) -> DataFrame:
    hit = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("rtype") == rtype)
    if edges.where(hit).isEmpty():
        raise ValueError("no such edge")
    return edges.where(~hit)


def set_property(table: DataFrame, hit, name: str, value: str | None) -> DataFrame:
    """Sets a property in a ``props`` map, or removes it (None)."""
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: k != name)
    new = kept if value is None else F.map_concat(kept, F.create_map(F.lit(name), F.lit(value)))
    return table.withColumn("props", F.when(hit, new).otherwise(F.col("props")))


def add_edge(edges: DataFrame, src, rtype: str, dst, **values) -> DataFrame:
    """A typed edge from src to dst with further columns (weight, props); one there already is replaced."""
    kinds = dict(edges.dtypes)
    new = {"src": src, "dst": dst, "rtype": rtype} | values
    row = edges.sparkSession.range(1).select(*[(_literal(new[c]) if c in new else F.lit(None)).cast(kinds[c]).alias(c) for c in edges.columns])
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst) & (F.col("rtype") == rtype))).unionByName(row)


def _literal(value):
    return F.create_map(*[F.lit(x) for kv in value.items() for x in kv]) if isinstance(value, dict) else F.lit(value)


def set_edge_property(edges: DataFrame, src, rtype: str, dst, name: str, value: str | None) -> DataFrame:
    """Sets or removes (None) a property of one edge; an error if there is none."""
    hit = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("rtype") == rtype)
    if edges.where(hit).isEmpty():
        raise ValueError("no such edge")
    return set_property(edges, hit, name, value)


def neighbours(edges: DataFrame, start: DataFrame, expander: str = "OUTGOING", rtype: str | None = None) -> DataFrame:
    """(id, there, rtype) one step from each row of ``start`` (id)."""
    return start.select("id").join(steps(edges, expander, rtype), F.col("id") == F.col("here")).select("id", "there", "rtype")


def connected_to(edges: DataFrame, dst, rtype: str) -> DataFrame:
    """Who has an edge of ``rtype`` to ``dst``: what an index over relations answers."""
    return edges.where((F.col("dst") == dst) & (F.col("rtype") == rtype)).select(F.col("src").alias("id")).distinct()


def traverse(vertices: DataFrame, edges: DataFrame, order: str, start, *options: str) -> DataFrame:
    """A traversal by named options, over vertices (id, name): ``REPLY.NODENAME``, ``REPLY.PATH``, ``REPLY.NODENAME_AND_PATH``;
    ``EXPANDER.`` OUTGOING, INCOMING or BOTH; ``TYPE.`` of edges; ``UNIQUENESS.`` NODE_GLOBAL, PATH_GLOBAL or NONE; ``MIN_DEPTH.``
    and ``MAX_DEPTH.`` numbers. Paths read ``A-[T]->B<-[T]-C`` over names, which take the place of ids."""
    given = dict(o.split(".", 1) for o in options)
    unknown = given.keys() - {"REPLY", "EXPANDER", "TYPE", "UNIQUENESS", "MIN_DEPTH", "MAX_DEPTH"}
    if unknown or order.upper() not in ("BFS", "DFS"):
        raise ValueError(f"unknown option {', '.join(sorted(unknown)) or order}")
    names = vertices.select("id", F.col("name").cast("string").alias("name"))
    named = edges.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")
    named = named.drop("src", "dst").withColumnsRenamed({"src_name": "src", "dst_name": "dst"})
    first = names.where(F.col("id") == start).first()
    if first is None:
        raise ValueError(f"no vertex {start}")
    walk = bfs if order.upper() == "BFS" else dfs
    out = walk(named, first.name, given.get("EXPANDER", "OUTGOING"), given.get("TYPE"), int(given.get("MIN_DEPTH", 1)), int(given["MAX_DEPTH"]) if "MAX_DEPTH" in given else None, given.get("UNIQUENESS", "NODE_GLOBAL"))
    out = out.withColumnRenamed("id", "nodename")
    reply = {"NODENAME": ["nodename"], "PATH": ["path"], "NODENAME_AND_PATH": ["nodename", "path"]}
    return out.select(*reply[given.get("REPLY", "NODENAME")], "depth")


def save(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables of a graph below ``path``; a later save replaces them."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def node_delta(vertices: DataFrame, a, b) -> DataFrame:
    """Euclidean distance of two vertices with x and y."""
    p, q = vertices.where(F.col("id") == a).alias("p"), vertices.where(F.col("id") == b).alias("q")
    return p.join(q, F.lit(True)).select(F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2)).alias("distance"))

