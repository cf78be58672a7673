"""Graph queries over all nodes and edges, against plain Python on the same table."""

import collections
import hashlib

import __spark_entry__ as entry
from harness import compare, connect

DIR = "/root/testdata/sf0.001"


def copy_graph(spark):
    adj = collections.defaultdict(set)
    for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                a, b = f"d{r.doc_id}", "h" + hashlib.md5(line.encode()).hexdigest()
                adj[a].add(b)
                adj[b].add(a)
    return adj


def component(adj, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        u = todo.pop()
        for v in adj[u] - seen:
            if {u, v} != without:
                seen.add(v)
                todo.append(v)
    return seen


def test_all_bridges_and_nodes(spark):
    adj, queries = copy_graph(spark), entry.queries()
    edges = {(u, v) for u in adj if u[0] == "d" for v in adj[u]}
    shared = {(u, v) for u, v in edges if len(adj[v]) > 1}
    want = (edges - shared) | {e for e in shared if e[1] not in component(adj, e[0], set(e))}
    assert want & shared  # bridges that join groups of documents
    assert {tuple(r) for r in queries["J13_bridges"](spark, DIR).collect()} == want
    share = {r.node: r.bridge_fraction for r in queries["J13_bridge_fraction"](spark, DIR).collect()}
    assert share == {n: round(sum(((n, m) if n[0] == "d" else (m, n)) in want for m in adj[n]) / len(adj[n]), 6) for n in adj}
    comp = {r.node: r.component for r in queries["J7_all_components"](spark, DIR).collect()}
    assert comp == {n: min(component(adj, n)) for n in adj}
    assert compare(queries["J7_all_components"](spark, DIR), connect(DIR), entry.oracle_sql()["J7_all_components"]) == []
