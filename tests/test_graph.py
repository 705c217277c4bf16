"""Breadth-first walk G1 against a direct FIFO-frontier simulation (FIXTURES.md crawl graph)."""

from collections import OrderedDict

from corpusmill.operators import graph as G


def fifo_crawl(edges, seed, has_doc, max_depth, max_visited):
    """The reference loop: FIFO frontier unique by url, visited set, depth and size limits."""
    out = {}
    for s, p, d in sorted(edges, key=lambda e: (e[0], e[1])):
        out.setdefault(s, []).append(d)
    frontier = OrderedDict([(seed, 1)])
    visited = OrderedDict()
    while frontier:
        url, depth = frontier.popitem(last=False)
        if max_depth is not None and depth > max_depth:
            break
        if url not in visited:
            visited[url] = depth
            if has_doc(url):
                for d in out.get(url, []):
                    if d not in visited and d not in frontier:
                        frontier[d] = depth + 1
        if max_visited is not None and len(visited) >= max_visited:
            break
    return list(visited.items())


def graph():
    e = []
    # cycle a -> b -> c -> a, self link on b, d reachable at depth 2 and 3
    e += [("a", 0, "b"), ("b", 0, "b"), ("b", 1, "c"), ("c", 0, "a"), ("a", 1, "d"), ("c", 1, "d")]
    # chain of 12 from d
    chain = ["d"] + [f"n{i}" for i in range(12)]
    e += [(chain[i], 0, chain[i + 1]) for i in range(12)]
    # dangling url (no document) and a wide level for the budget
    e += [("b", 2, "dangling"), ("dangling", 0, "never")]
    e += [("c", 2 + i, f"w{i}") for i in range(6)]
    return e


def run(spark, seed, max_depth, max_visited):
    edges = graph()
    has_doc = lambda u: u != "dangling"
    expected = fifo_crawl(edges, seed, has_doc, max_depth, max_visited)
    e = spark.createDataFrame(edges, "src string, pos long, dest string")
    expandable = spark.createDataFrame([(u,) for u in {s for s, _, _ in edges} if has_doc(u)], "url string")
    seeds = spark.createDataFrame([(seed,)], "url string")
    got = G.bfs(e, seeds, expandable, max_depth, max_visited).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(len(got)))
    return expected, [(r.url, r.depth) for r in got]


def test_bfs_matches_fifo_crawl(spark):
    expected, got = run(spark, "a", 10, 10000)
    assert got == expected
    assert ("n11", 14) not in got and max(d for _, d in got) == 10


def test_bfs_budget_cuts_inside_level(spark):
    expected, got = run(spark, "a", 10, 7)
    assert got == expected and len(got) == 7


def test_unknown_seed_is_visited_alone(spark):
    expected, got = run(spark, "nowhere", 10, 10000)
    assert got == expected == [("nowhere", 1)]


def test_without_limits_everything_is_reached(spark):
    expected, got = run(spark, "a", None, None)
    assert got == expected and ("n11", 14) in got
