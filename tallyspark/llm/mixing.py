"""Mixing overlapping sources to target weights by a min-cost flow.

1. Documents are grouped by membership pattern, the set of sources that hold them, and by the sources that they can serve;
   their sizes are summed. Where the sources hold copies of one text (`copies`), a copy serves its own source, and the pattern
   counts the words of its different texts once.
2. Token capacity flows pattern -> group -> source -> quota. A pattern's first use costs nothing, each further use more
   (convex), and a document gives at most `repeats` times its size. The flow fills the quotas at least repetition: a source
   that needs more than its own words repeats those that no other source uses. A source that shares no document with another
   gives the lesser of quota and limit; sources that overlap are linked to connected groups, and each one's flow is solved by
   itself in one task.
3. Of each group with flow f and size s, every document is taken f // s times, and documents in a seeded order once more
   until the rest of f is met. The seeded order is one of contents, cut in SLOTS slots by hash; the groups of a pattern begin
   where those before them end, so that they take different texts as long as there are some. Whole slots are decided from their
   sums, and only the slot that the cut falls into is ordered document by document. The document on the cut gives the words that
   are left (`taken`); as a whole document it counts (`times`) when that is at least half of it.

The driver holds sums by weight only. Patterns, groups, sources and the plan are tables of any length; the plan is broadcast up to
MOST_BROADCAST patterns and joined by group and slot beyond, so that a large source is spread over its slots.

Nulls and odd input: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; repeated
rows are documents of their own; other columns are ignored; with no words at all every target is 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import components
from .shared import WORD, stored

WEIGHTS, SHARE, REPEATS, SLOTS, MOST_BROADCAST = (5, 2, 1), 1.5, 2, 4096, 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = REPEATS) -> list[float]:
    """Shares of `total` by weight; one that would exceed `most` times its size stops there, and its excess is shared again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def source_goals(by_pattern: DataFrame, weights: Sequence[float], total: float, most: float = REPEATS) -> tuple[DataFrame, int]:
    """`targets` over a table: key, place (in order of code point, null last), source_size, target, quota for each source; and their number.

    The unit only rises from round to round, so a round needs one aggregate by weight.
    """
    sums = by_pattern.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = stored(sums.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, starts, n = F.shiftright("at", 33).cast("int"), {}, 0
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition
        starts[row["part"]] = n
        n += row["count"]
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts, default=0) + 1)]), part + 1)
    placed = placed.withColumn("place", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    kind = (F.col("place") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)
    full, bar, unit, was = F.lit(False), 0.0, 0.0, None
    while True:
        found = placed.groupBy(kind.alias("kind")).agg(F.count_if(~full).alias("free"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held")).orderBy("kind").collect()
        free = sum(r["free"] for r in found)
        if free in (0, was):
            break
        unit, was = (total - most * sum(r["held"] for r in found)) / sum(r["free"] * weights[r["kind"]] for r in found), free
        bar = max(bar, unit)
        full = F.lit(bar) * weight > most * F.col("source_size")
    target = F.when(full, most * F.col("source_size").cast("double")).otherwise(F.lit(unit) * weight)
    goals = placed.select(F.to_json(F.array("source")).alias("key"), "place", "source_size", target.alias("target"))
    return stored(goals.withColumn("quota", F.rint("target").cast("long")), "goals"), n


def augment(graph: list[list[int]], to: list[int], room: list[int], start: int, end: int) -> None:
    """Fills a network to its maximum flow by Dinic's levels; arc e and its reverse are e and e ^ 1."""
    while True:
        level, queue = [-1] * len(graph), [start]
        level[start] = 0
        for x in queue:
            for e in graph[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[end] < 0:
            return
        turn, path, x = [0] * len(graph), [], start
        while True:
            if x == end:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[first] ^ 1]
                del path[first:]
            while turn[x] < len(graph[x]) and not (room[graph[x][turn[x]]] and level[to[graph[x][turn[x]]]] == level[x] + 1):
                turn[x] += 1
            if turn[x] < len(graph[x]):
                path.append(graph[x][turn[x]])
                x = to[path[-1]]
            elif x == start:
                break
            else:
                x = to[path.pop() ^ 1]
                turn[x] += 1


def route_groups(patterns: Sequence[int], groups: Sequence[tuple[int, Sequence[int], int]], quotas: Sequence[int]) -> list[int]:
    """Words to take from each group (pattern, sources it can serve, most words) so that the quotas of the sources are met with
    least repetition of the patterns' words.

    The cost of a pattern's words is convex: the first use of all of them is free, and each doubling costs more. Only the arcs from the
    start cost, and no cheapest path goes back over them; so a cheapest maximum flow is one maximum flow after another, each with
    the next step of every pattern let in.
    """
    p, g, s = len(patterns), len(groups), len(quotas)
    start, end = p + g + s, p + g + s + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room = [], []
    most = [0] * p
    for i, _, cap in groups:
        most[i] += cap
    arcs = [(start, i, 0) for i in range(p)] + [(i, p + k, cap) for k, (i, _, cap) in enumerate(groups)]
    arcs += [(p + k, p + g + j, cap) for k, (_, members, cap) in enumerate(groups) for j in members]
    for a, b, c in arcs + [(p + g + j, end, quota) for j, quota in enumerate(quotas)]:
        for x, y, r in ((a, b, c), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
    step, given = list(patterns), [0] * p
    while any(x < y for x, y in zip(given, most)):
        for i in range(p):
            more = min(step[i], most[i] - given[i]) if step[i] else most[i] - given[i]
            room[2 * i] += more
            given[i] += more
            step[i] = given[i]
        augment(graph, to, room, start, end)
    return [room[2 * (p + k) + 1] for k in range(g)]


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int = REPEATS) -> list[int]:
    """`route_groups` where each pattern (members, size) is one group that can serve all its members."""
    return route_groups([size for _, size in patterns], [(i, members, repeats * size) for i, (members, size) in enumerate(patterns)], quotas)


def overlapping(groups: DataFrame, goals: DataFrame, repeats: int) -> DataFrame:
    """g, flow, turn of every group whose pattern has several sources or whose source is in such a pattern.

    groups: g, p, pattern, serves, words, unique (words of the pattern's different texts). turn: the share of the pattern's words
    that its earlier groups take, where this one begins.
    """
    several = groups.where(F.size("pattern") > 1).select(F.explode("pattern").alias("source"), "pattern")
    key = lambda c: F.to_json(F.array(c))
    links = several.select(key("source").alias("key"), key(F.get("pattern", F.lit(0))).alias("other")).distinct()
    place = goals.select("key", "place")
    links = links.join(place, "key").join(place.select(F.col("key").alias("other"), F.col("place").alias("b")), "other").select(F.col("place").alias("a"), "b")
    label = stored(components(links), "labels")
    served = groups.select("g", "p", "unique", "words", F.explode("serves").alias("source")).withColumn("key", key("source"))
    served = served.join(goals.select("key", "place", "quota"), "key").join(label, F.col("place") == F.col("node"))
    served = served.groupBy("g", "p", "unique", "words").agg(F.min("component").alias("component"), F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("members"))

    def solve(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["g", "p", "unique", "words", "members"]).to_pylist(), key=lambda r: (r["p"], r["g"]))
        quota = {m["place"]: m["quota"] for r in rows for m in r["members"]}
        local = {x: i for i, x in enumerate(sorted(quota))}
        unique = {r["p"]: r["unique"] for r in rows}
        number = {x: i for i, x in enumerate(unique)}
        flow = route_groups([*unique.values()], [(number[r["p"]], [local[m["place"]] for m in r["members"]], repeats * r["words"]) for r in rows], [quota[x] for x in local])
        turn, taken = [], dict.fromkeys(unique, 0)
        for r, f in zip(rows, flow):
            turn.append(taken[r["p"]] / r["unique"] % 1.0 if r["unique"] else 0.0)
            taken[r["p"]] += f
        return pa.table({"g": pa.array([r["g"] for r in rows], pa.string()), "flow": pa.array(flow, pa.int64()), "turn": pa.array(turn, pa.float64())})

    return stored(served.groupBy("component").applyInArrow(solve, "g string, flow long, turn double"), "flows")


def shared_texts(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with `members`: all sources that hold the row's text; texts without words are in their own source alone.

    Of the (text, source) pairs only their hashes and names are shuffled, once for each task; texts that several sources hold
    are joined back, by broadcast where they are few.
    """
    content = F.when(F.regexp_like(text_col, F.lit(WORD)), F.sha2(F.col(text_col).cast("binary"), 256))
    pairs = docs.select(content.alias("_content"), F.struct(F.col(source_col).alias("s")).alias("s")).where("_content is not null").distinct()
    several = pairs.groupBy("_content").agg(F.count("*").alias("n"), F.collect_list("s").alias("s")).where("n > 1")
    several = stored(several.select("_content", F.transform("s", lambda x: x["s"]).alias("members")), "several")
    few = several.count() <= MOST_BROADCAST
    joined = docs.withColumn("_content", content).join(F.broadcast(several) if few else several, "_content", "left").drop("_content")
    return joined.withColumn("members", F.coalesce("members", F.array(F.col(source_col))))


def mix_sources(docs: DataFrame, members: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, copies: bool = False) -> DataFrame:
    """Every row: id, pattern (array of sources), size, times (whole uses), taken (words), and the sums and
    targets of its first served source: source_size, target.

    members: array of a document's sources, any of which it can serve; default: its one source. copies: a document serves its own
    source only, and its pattern are all sources that hold the same text, so that copies share the cost of repetition. carry: adds the
    input row as struct `doc`. Sources are in order of code point, null last, and weigh `weights`, repeating. The sum of a source
    counts every document that can serve it.
    """
    own = docs.withColumn("_doc", F.struct("*")) if carry else docs
    own = own.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(source_col).alias("source")] if members is None else [F.lit(None).cast("string").alias("source"), members.alias("members")]), *(["_doc"] if carry else []))
    own = shared_texts(own, "text") if copies else own
    held = F.col("members") if copies or members is not None else F.array("source")
    pattern = F.coalesce(F.array_sort(F.array_distinct(held)), F.array().cast("array<string>"))
    serves = F.array("source") if copies else F.col("pattern")
    own = own.select("id", pattern.alias("pattern"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content"), "source", *([F.col("_doc").alias("doc")] if carry else []))
    # the seeded order runs over contents, so that copies in several sources stand at one place of it
    order = [F.xxhash64(F.lit(seed + 1), "content"), F.xxhash64(F.lit(seed + 2), "id", "size"), F.col("id"), F.col("size")]
    own = own.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "content"), F.lit(SLOTS)).cast("int"))
    own = own.withColumn("serves", serves).withColumn("p", F.to_json("pattern")).withColumn("g", F.to_json(F.struct("pattern", "serves")))
    slots = stored(own.groupBy("pattern", "serves", "p", "g", "slot").agg(F.sum("size").alias("words")), "slots")
    groups = slots.groupBy("g", "p", "pattern", "serves").agg(F.sum("words").alias("words"))
    several = F.size("pattern") > 1
    if copies:
        unique = own.where(several).groupBy("p", "content").agg(F.max("size").alias("size")).groupBy("p").agg(F.sum("size").alias("unique"))
        groups = groups.join(unique, "p", "left")
    groups = stored(groups.withColumn("unique", F.col("unique") if copies else F.col("words")).withColumn("unique", F.coalesce("unique", "words")), "groups")
    n, total, shared = groups.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0)), F.count_if(several)).first()
    goals, n_sources = source_goals(groups.select(F.col("serves").alias("pattern"), "words"), weights, share * total)
    few = lambda df, k: F.broadcast(df) if k <= MOST_BROADCAST else df
    plan = groups.withColumn("key", F.to_json(F.slice("serves", 1, 1))).join(few(goals, n_sources), "key", "left")
    flow, turn = F.when(F.size("pattern") == 1, F.least("quota", repeats * F.col("words"))).otherwise(F.lit(0)), F.lit(0.0)
    if shared:
        plan = plan.join(overlapping(groups, goals, repeats).withColumnRenamed("flow", "routed"), "g", "left")
        flow, turn = F.coalesce("routed", flow), F.coalesce("turn", turn)
    plan = plan.select("g", F.col("words").alias("group_size"), flow.alias("flow"), F.floor(turn * SLOTS).cast("int").alias("first"), F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    plan = plan.withColumn("whole", F.when(F.col("group_size") > 0, F.floor(F.col("flow") / F.col("group_size"))).otherwise(F.lit(0)).cast("long"))
    plan = stored(plan.withColumn("rest", F.col("flow") - F.col("whole") * F.col("group_size")), "plan")
    turned = F.pmod(F.col("slot") - F.col("first"), F.lit(SLOTS)).alias("turned")
    before = Window.partitionBy("g").orderBy("turned").rowsBetween(Window.unboundedPreceding, -1)  # SLOTS rows for each group
    placed = slots.select("g", "slot", "words").join(few(plan.select("g", "rest", "first"), n), "g").select("g", "words", "rest", turned)
    placed = stored(placed.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0))), "slots")
    on_cut = (F.col("below") < F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest"))
    cuts = placed.groupBy("g").agg(F.max(F.when(on_cut, F.col("turned"))).alias("cut"), F.max(F.when(on_cut, F.col("below"))).alias("below"), F.max(F.when(F.col("below") < F.col("rest"), F.col("turned"))).alias("last"))
    plan = stored(plan.join(cuts, "g", "left"), "plan")
    by_slot = slots.select("g", "slot").join(plan, "g") if n > MOST_BROADCAST else None
    own = own.drop("serves", "source", "p")
    rows = own.join(F.broadcast(plan), "g") if by_slot is None else own.join(by_slot, ["g", "slot"])
    rows = rows.withColumn("turned", turned)
    inside = F.coalesce(F.col("turned") == F.col("cut"), F.lit(False))
    first = Window.partitionBy("g", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(inside).withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(first), F.lit(0)))
    cut = cut.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at")))).drop("at")
    rest = rows.where(~inside).withColumn("more", F.when(F.col("turned") <= F.col("last"), F.col("size")).otherwise(F.lit(0)))
    every = rest.unionByName(cut)
    times = F.col("whole") + ((F.col("more") > 0) & (2 * F.col("more") >= F.col("size"))).cast("long")
    return every.select(F.col("id").alias(id_col), "pattern", "size", "source_size", "target", times.alias("times"), (F.col("size") * F.col("whole") + F.col("more")).alias("taken"), *(["doc"] if carry else []))
