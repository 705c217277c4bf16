"""Link-graph walk.

Breadth-first by levels: a level is one join of the newest nodes with the edge
table, an anti join against every node already seen (J1), and a ``min`` of the
insertion key per new node (a node is queued by its first link only).  The
visit order of the reference's FIFO frontier is ``(depth, parent rank, link
position)``; each level gets global ranks from the distributed row number,
whose checkpoint also cuts the lineage once per level.  The walk ends when a level
brings no new URL, or at a limit that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import global_row_number
from corpusmill.session import cut_lineage


def _first_key():
    """Order key of a link: parent rank, then position, as one decimal whose ``min`` a hash
    aggregate takes.  Positions have 19 digits at most, and the rank stands above them."""
    rank, pos = F.col("rank").cast("decimal(18,0)"), F.col("pos").cast("decimal(19,0)")
    return (rank * F.lit(str(10 ** 19)).cast("decimal(20,0)") + pos).cast("decimal(38,0)")


def bfs(edges: DataFrame, seeds: DataFrame, expandable: DataFrame | None = None,
        max_depth: int | None = None, max_visited: int | None = None) -> DataFrame:
    """G1: ``(url, depth, rank)`` of every visited URL.

    ``edges`` is ``(src, pos, dest)`` already filtered by the follow rule;
    ``seeds`` is ``(url)`` ranked by url (the seed is not tested by the rule);
    ``expandable`` lists the URLs that have a document - others are visited but
    not expanded (all ``src`` of ``edges`` when ``None``).  Without limits the walk
    reaches everything; with them it stops past ``max_depth`` or once ``max_visited``
    URLs are visited, possibly inside a level.
    """
    level = global_row_number(seeds.select("url").distinct(), [F.col("url")], "rank").select(
        "url", F.lit(1).alias("depth"), "rank")
    total = level.count()
    levels = [level]
    seen = level.select("url")
    # The edge table is joined once per level: dealt by its source and materialised once.
    edges = cut_lineage(edges.select("src", "pos", "dest").repartition("src"))
    depth = 1
    while (max_depth is None or depth < max_depth) and (max_visited is None or total < max_visited):
        src = level.select("url", "rank")
        if expandable is not None:
            src = src.join(expandable.select("url").distinct(), "url", "left_semi")
        cand = (src.join(edges, src["url"] == edges["src"])
                .select(F.col("dest").alias("url"), _first_key().alias("key")))
        cand = cand.join(seen, "url", "left_anti")
        nxt = cand.groupBy("url").agg(F.min("key").alias("key"))
        nxt = global_row_number(nxt, [F.col("key")], "rank", start=total).select(
            "url", F.lit(depth + 1).alias("depth"), "rank")
        n = nxt.count()
        if n == 0:
            break
        levels.append(nxt)
        level = nxt
        seen = seen.unionByName(nxt.select("url"))
        total += n
        depth += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out if max_visited is None else out.filter(F.col("rank") < max_visited)


def crawl_totals(visited: DataFrame) -> DataFrame:
    """Deepest level reached and number of URLs visited."""
    return visited.agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).cast("long").alias("visited"))


def split_cached(frontier: DataFrame, stored: DataFrame, url_col: str = "url"
                 ) -> tuple[DataFrame, DataFrame]:
    """(already stored, to fetch) by semi and anti join on the url."""
    s = stored.select(F.col(url_col)).distinct()
    return (frontier.join(s, url_col, "left_semi"), frontier.join(s, url_col, "left_anti"))


def first_seen_links(links: DataFrame, src_rank: DataFrame) -> DataFrame:
    """U2 + ranks: distinct link destinations, each ranked by its first
    ``(source rank, position)``; ``src_rank`` is ``(url, rank)`` of the sources."""
    j = links.join(src_rank.withColumnRenamed("url", "src"), "src")
    first = j.groupBy(F.col("dest").alias("url")).agg(F.min(_first_key()).alias("key"))
    return global_row_number(first, [F.col("key")], "rank").select("url", "rank")
