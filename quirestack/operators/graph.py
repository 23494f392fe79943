"""Trees and graphs: depths below chosen nodes by pointer jumping, longest chains of includes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def depths_below(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth, root) of every node that is a root or below one, by its nearest; tree: (id, parent), one row a node; roots: (id).

    Pointers jump: each round a node takes its pointer's pointer until that is a root, so the rounds grow with the
    logarithm of the depth, and there is no bound on depth or rows.  Nodes whose way up ends elsewhere or in a cycle are left out.
    """
    marks = roots.select(F.col("id").alias("root")).distinct()
    ups = tree.join(marks, tree["id"] == marks["root"], "left_anti").where("parent IS NOT NULL").select("id", F.col("parent").alias("up"), F.lit(1).alias("depth"))
    going = stored(ups.join(marks, F.col("up") == F.col("root"), "left"), "pointers")
    out, rounds = marks.select(F.col("root").alias("id"), F.lit(0).alias("depth"), "root"), 0
    most = max(1, going.count()).bit_length() + 1
    while True:
        out = out.unionByName(going.where("root IS NOT NULL").select("id", "depth", "root"))
        open_ = going.where("root IS NULL")
        if rounds > most or open_.isEmpty():
            return out
        above = going.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("found"))
        jumped = open_.drop("root").join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("found").alias("root"))
        # Settled nodes stay as pointers for those below them.
        settled = going.where("root IS NOT NULL")
        after = stored(jumped.unionByName(settled.select(jumped.columns)), "pointers")
        going, out, rounds = after, marks.select(F.col("root").alias("id"), F.lit(0).alias("depth"), "root"), rounds + 1


def _components(nodes: list, down: dict) -> list[list]:
    """Strongly connected components, those that others lead to first; a stack stands for the recursion."""
    order, low, on, stack, out, n = {}, {}, set(), [], [], 0
    for first in nodes:
        if first in order:
            continue
        work = [(first, iter(down.get(first, ())))]
        order[first] = low[first] = n
        n += 1
        stack.append(first)
        on.add(first)
        while work:
            at, rest = work[-1]
            step = next((x for x in rest if x not in order or x in on), None)
            if step is not None and step not in order:
                order[step] = low[step] = n
                n += 1
                stack.append(step)
                on.add(step)
                work.append((step, iter(down.get(step, ()))))
                continue
            if step is not None:
                low[at] = min(low[at], order[step])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[at])
            if low[at] == order[at]:
                part = []
                while not part or part[-1] != at:
                    part.append(stack.pop())
                    on.discard(part[-1])
                out.append(part)
    return out


def longest_chains(edges: list[tuple], roots: list) -> list[int]:
    """Edges of the longest path from each root that meets no node twice.

    A path never comes back to a component that it has left, so chains add up over components, in whose order every
    node is looked at once; only inside a cycle are ways tried one by one.
    """
    down: dict = {}
    for a, b in edges:
        if a != b:
            down.setdefault(a, {})[b] = True
    best: dict = {}
    for part in _components([*roots, *down], down):
        inside = set(part)
        leave = {u: max((1 + best[v] for v in down.get(u, ()) if v not in inside), default=0) for u in part}
        for u in part:
            best_u, work = leave[u], [(u, iter(down.get(u, ())), {u})]
            while work and len(part) > 1:
                at, rest, seen = work[-1]
                step = next((v for v in rest if v in inside and v not in seen), None)
                if step is None:
                    work.pop()
                    continue
                best_u = max(best_u, len(seen) + leave[step])
                work.append((step, iter(down.get(step, ())), seen | {step}))
            leave[u], best[u] = leave[u], best_u
    return [best[r] for r in roots]


def include_depth(edges: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(key, root, depth): the longest chain of includes from each root that meets no file twice; edges: (key, a, b), roots: (key, a).

    key names a document, whose files and includes fit in a row; chains and cycles may be of any length.
    """
    kind = edges.schema["a"].dataType.simpleString()
    run = F.pandas_udf(lambda e, r: pd.Series([longest_chains([(x["a"], x["b"]) for x in pairs], list(tops)) for pairs, tops in zip(e, r)], dtype=object), "array<int>")
    tops = roots.groupBy(*key).agg(F.sort_array(F.collect_set("a")).alias("_roots"))
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("_edges"))
    none = F.array().cast(f"array<struct<a:{kind},b:{kind}>>")
    rows = tops.join(links, key, "left").select(*key, "_roots", run(F.coalesce("_edges", none), F.col("_roots")).alias("_depths"))
    return rows.select(*key, F.explode(F.arrays_zip(F.col("_roots").alias("root"), F.col("_depths").alias("depth"))).alias("_z")).select(*key, "_z.root", "_z.depth")
