"""Graph algorithms over edges (seq, src, dst, weight).

Traversals advance a frontier by joins, one written step at a time.  Orders that are sequential by
definition (depth first, trees by growth) run on the driver over the adjacency, which is checked for size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.sources.tables import checkpointed

#: Edges that a sequential algorithm may bring to one machine.
DRIVER_EDGES = 2_000_000


def both_ways(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, weight, seq, way) as adjacency: undirected edges in either direction."""
    out = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), "seq", F.lit(0).alias("way"))
    return out if directed else out.union(edges.select("dst", "src", F.col("weight").cast("double"), "seq", F.lit(1)))


def degree(edges: DataFrame, vertices: DataFrame, directed: bool = False) -> DataFrame:
    """(v, degree): entries of the adjacency; an undirected loop counts twice."""
    n = both_ways(edges, directed).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("v").join(n, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def hops(edges: DataFrame, start, directed: bool = False) -> DataFrame:
    """(v, hops) of every vertex that can be reached: a frontier of new vertices a step."""
    adj = both_ways(edges, directed).select("src", "dst").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "v long, hops int")
    front, k = seen, 0
    while True:
        k += 1
        new = adj.join(front.select(F.col("v").alias("src")), "src").select(F.col("dst").cast("long").alias("v")).distinct().join(seen, "v", "left_anti").withColumn("hops", F.lit(k))
        front = checkpointed(new)
        if not front.limit(1).count():
            return seen
        seen = checkpointed(seen.union(front))


def reachable(edges: DataFrame, start, directed: bool = False) -> DataFrame:
    return hops(edges, start, directed).select("v")


def bfs(edges: DataFrame, start, directed: bool = False) -> list:
    """Order of visits, neighbours as their edges came."""
    adj, seen, queue, out = _adjacency(edges, directed), {start}, deque([start]), []
    while queue:
        v = queue.popleft()
        out.append(v)
        for u, _ in adj[v]:
            if u not in seen:
                seen.add(u)
                queue.append(u)
    return out


def _adjacency(edges: DataFrame, directed: bool) -> dict:
    if edges.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES:
        raise ValueError("too many edges for a sequential algorithm")
    adj = defaultdict(list)
    for r in both_ways(edges, directed).orderBy("seq", "way").collect():
        adj[r["src"]].append((r["dst"], r["weight"]))
    return adj


def dfs(edges: DataFrame, start, directed: bool = False) -> list:
    """Preorder with an explicit stack."""
    adj, seen, stack, out = _adjacency(edges, directed), set(), [start], []
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            stack.extend(u for u, _ in reversed(adj[v]) if u not in seen)
    return out


def shortest_paths(edges: DataFrame, start, directed: bool = True, most: int | None = None) -> DataFrame:
    """(v, distance, parent) by repeated relaxation of all edges; negative weights are allowed, negative cycles are an error.

    Vertices out of reach are left out.  Each round is one join and one aggregate; only vertices that improved send on.
    """
    adj = checkpointed(both_ways(edges, directed).select(F.col("src").cast("long"), F.col("dst").cast("long"), "weight"))
    limit = most or adj.select(F.col("src").alias("v")).union(adj.select("dst")).distinct().count()
    best = edges.sparkSession.createDataFrame([(start, 0.0, None)], "v long, distance double, parent long")
    front, k = best, 0
    while True:
        k += 1
        offer = adj.join(front.select(F.col("v").alias("src"), "distance"), "src").select(F.col("dst").alias("v"), (F.col("distance") + F.col("weight")).alias("d"), F.col("src").alias("p"))
        offer = offer.groupBy("v").agg(F.min(F.struct("d", "p")).alias("o"))
        better = offer.join(best.select("v", F.col("distance").alias("was")), "v", "left").where("was is null or o.d < was")
        front = checkpointed(better.select("v", F.col("o.d").alias("distance"), F.col("o.p").alias("parent")))
        if not front.limit(1).count():
            return best
        if k > limit:
            raise ValueError("the graph has a negative cycle")
        best = checkpointed(best.join(front, "v", "left_anti").union(front))


def bellman_ford(edges: DataFrame, start, directed: bool = True) -> DataFrame:
    return shortest_paths(edges, start, directed)


def dijkstra(edges: DataFrame, start, directed: bool = False) -> DataFrame:
    if edges.where("weight < 0").limit(1).count():
        raise ValueError("negative weights")
    return shortest_paths(edges, start, directed)


def floyd_warshall(edges: DataFrame, vertices: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, distance) of all pairs, infinity where there is no way; paths double in length each round."""
    v = vertices.select(F.col("v").cast("long"))
    pairs = v.withColumnRenamed("v", "src").crossJoin(v.withColumnRenamed("v", "dst"))
    own = v.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("distance"))
    least = F.min("distance").alias("distance")
    now = checkpointed(own.union(both_ways(edges, directed).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").alias("distance"))).groupBy("src", "dst").agg(least))
    length, n = 1, v.count()
    while length < n:
        left = now.select("src", F.col("dst").alias("mid"), F.col("distance").alias("a"))
        now = checkpointed(left.join(now.select(F.col("src").alias("mid"), "dst", F.col("distance").alias("b")), "mid").select("src", "dst", (F.col("a") + F.col("b")).alias("distance")).union(now.select("src", "dst", "distance")).groupBy("src", "dst").agg(least))
        length *= 2
        if now.where("src = dst and distance < 0").limit(1).count():
            raise ValueError("the graph has a negative cycle")
    return pairs.join(now, ["src", "dst"], "left").select("src", "dst", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex of each weak component; labels spread and jump, a written step each."""
    labels = checkpointed(vertices.select(F.col("v").cast("long").alias("v"), F.col("v").cast("long").alias("component")))
    adj = checkpointed(both_ways(edges).select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct())
    while True:
        near = adj.join(labels.select(F.col("v").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("v")).agg(F.min("component").alias("near"))
        least = labels.join(near, "v", "left").select("v", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        top = labels.select(F.col("v").alias("component"), F.col("component").alias("top"))
        new = checkpointed(least.join(top, "component").select("v", "was", F.least("top", "component").alias("component")))
        if not new.where("was <> component").limit(1).count():
            return new.select("v", "component")
        labels = new.select("v", "component")


def topological_sort(edges: DataFrame, vertices: DataFrame) -> list:
    """First in, first out from the smallest vertices without predecessors; a cycle is an error."""
    adj, into = _adjacency(edges, True), defaultdict(int)
    for outs in adj.values():
        for u, _ in outs:
            into[u] += 1
    all_ = [r[0] for r in vertices.select("v").orderBy("v").collect()]
    queue, out = deque(v for v in all_ if not into[v]), []
    while queue:
        v = queue.popleft()
        out.append(v)
        for u, _ in adj[v]:
            into[u] -= 1
            if not into[u]:
                queue.append(u)
    if len(out) != len(all_):
        raise ValueError("the graph has a cycle")
    return out


def has_cycle(edges: DataFrame) -> bool:
    """Does a directed cycle remain when vertices without successors or predecessors go, again and again?"""
    left = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    n = left.count()
    while n:
        left = checkpointed(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = left.count()
        if m == n:
            return True
        n = m
    return False


def kruskal_mst(edges: DataFrame) -> DataFrame:
    """Edges of a minimum spanning forest: each component takes its lightest outgoing edge, then components merge."""
    e = checkpointed(edges.select("seq", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")).where("src <> dst"))
    vertices = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
    label = checkpointed(vertices.select("v", F.col("v").alias("component")))
    chosen = None
    while True:
        a, b = label.select(F.col("v").alias("src"), F.col("component").alias("ca")), label.select(F.col("v").alias("dst"), F.col("component").alias("cb"))
        out = e.join(a, "src").join(b, "dst").where("ca <> cb")
        ends = out.select(F.col("ca").alias("c"), "weight", "seq").union(out.select("cb", "weight", "seq"))
        best = checkpointed(ends.groupBy("c").agg(F.min(F.struct("weight", "seq")).alias("b")).select(F.col("b.seq").alias("seq")).distinct())
        if not best.limit(1).count():
            return e.join(chosen, "seq") if chosen is not None else e.limit(0)
        chosen = checkpointed(best if chosen is None else chosen.union(best).distinct())
        label = connected_components(e.join(chosen, "seq").select("seq", "src", "dst", "weight"), vertices)


def prim_mst(edges: DataFrame, start=0) -> tuple[list[tuple], float]:
    """Edges (src, dst, weight) in the order that a tree grows from start, and their weight; undirected."""
    adj, seen, out = _adjacency(edges, False), {start}, []
    heap = [(w, start, u) for u, w in adj[start]]
    heapq.heapify(heap)
    while heap:
        w, v, u = heapq.heappop(heap)
        if u not in seen:
            seen.add(u)
            out.append((v, u, w))
            for x, wx in adj[u]:
                if x not in seen:
                    heapq.heappush(heap, (wx, u, x))
    return out, sum(e[2] for e in out)


def find_path(edges: DataFrame, source, target, directed: bool = False) -> list | None:
    """A path of fewest edges, or None."""
    adj, back, queue = _adjacency(edges, directed), {source: None}, deque([source])
    while queue:
        v = queue.popleft()
        if v == target:
            path = []
            while v is not None:
                path.append(v)
                v = back[v]
            return path[::-1]
        for u, _ in adj[v]:
            if u not in back:
                back[u] = v
                queue.append(u)
    return None


def find_cycles(edges: DataFrame) -> list[list]:
    """All simple directed cycles, each from its smallest vertex."""
    adj, out = _adjacency(edges, True), []
    for s in sorted(adj):
        stack = [(s, [s])]
        while stack:
            v, path = stack.pop()
            for u in dict.fromkeys(u for u, _ in adj[v]):
                if u == s:
                    out.append(path)
                elif u > s and u not in path:
                    stack.append((u, [*path, u]))
    return sorted(out)


def edge_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edges from (src, dst) or (src, dst, weight)."""
    return spark.createDataFrame([(i, r[0], r[1], float(r[2]) if len(r) > 2 else 1.0) for i, r in enumerate(rows)], "seq long, src long, dst long, weight double")


def with_seq(edges: DataFrame, *order: str) -> DataFrame:
    return edges.withColumn("seq", F.row_number().over(Window.orderBy(*order)) - 1)
