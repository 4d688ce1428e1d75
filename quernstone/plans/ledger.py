"""The event log: deduplicated append, references between events, links, and what is wrong with them.

An event is a row with seq, event_id, dedup_key, raw_hash, message_key and refs: array<struct<kind,target>>; kind is
``event_id`` or ``message_key``. All work is set-based; only the order in which cyclic links are refused is per edge.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.values import event_id, raw_hash
from quernstone.sources.catalog import durable

FLAG_DANGLING = 1
# Where an event may come from.
SOURCES = ("live", "history", "on_demand_history", "app_state", "app_state_recovery", "receipt", "identity_resolution", "scrub", "legacy_snapshot", "system_contacts")


def with_ids(events: DataFrame, dedup: str = "dedup_key", raw: str = "raw") -> DataFrame:
    hashed = events.withColumn("raw_hash", raw_hash(F.col(raw)))
    return hashed.withColumn("event_id", event_id(F.col(dedup), F.col("raw_hash")))


def faults(events: DataFrame) -> DataFrame:
    """events with fault: why a row can't be appended (unknown source, no id, type or key, no hash of 64 hex digits), null if it can."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = (
        F.when(blank("event_id"), "event_id").when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source").when(blank("event_type"), "event_type").when(blank("dedup_key"), "dedup_key")
        .when(~F.coalesce(F.col("raw_hash").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "raw_hash")
    )
    return events.withColumn("fault", fault)


def valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that may be appended, and the others with their fault. Nothing is lost: the two together are all rows."""
    judged = faults(events)
    return judged.filter("fault IS NULL").drop("fault"), judged.filter("fault IS NOT NULL")


def new_events(batch: DataFrame, ledger: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Rows of batch to append: the first of each (dedup_key, raw_hash) that the ledger doesn't have. The same key with other bytes is another event."""
    pair = ["dedup_key", "raw_hash"]
    fresh = batch if ledger is None else batch.join(ledger.select(*pair), pair, "left_anti")
    rest = [c for c in batch.columns if c not in pair]
    return fresh.groupBy(*pair).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*pair, "__r.*").select(*batch.columns)


def tail(ledger: DataFrame, after: int = 0, upto: int = 0) -> DataFrame:
    """Events with after < seq <= upto; upto 0 is the head."""
    df = ledger.filter(F.col("seq") > after)
    return (df.filter(F.col("seq") <= upto) if upto else df).orderBy("seq")


def references(ledger: DataFrame) -> DataFrame:
    """(seq, event_id, ref_index, kind, target)."""
    return ledger.select("seq", "event_id", F.posexplode("refs").alias("ref_index", "r")).select("seq", "event_id", "ref_index", "r.kind", "r.target")


def _targets(ledger: DataFrame) -> DataFrame:
    """Where each lookup key first stands: (kind, target, target_seq, target_id). One equi-join serves both kinds of reference."""
    by_key = ledger.filter(F.col("message_key").isNotNull()).select(F.lit("message_key").alias("kind"), F.col("message_key").alias("target"), "seq", "event_id")
    by_id = ledger.select(F.lit("event_id").alias("kind"), F.col("event_id").alias("target"), "seq", "event_id")
    return by_key.unionByName(by_id).groupBy("kind", "target").agg(F.min("seq").alias("target_seq"), F.min_by("event_id", "seq").alias("target_id"))


def resolved(ledger: DataFrame, forward_only: bool = False) -> DataFrame:
    """references with target_seq and target_id, null if the target isn't there (with forward_only: not before the event)."""
    found = references(ledger).join(_targets(ledger), ["kind", "target"], "left")
    if forward_only:
        known = F.col("target_seq") < F.col("seq")
        found = found.withColumns({"target_id": F.when(known, F.col("target_id")), "target_seq": F.when(known, F.col("target_seq"))})
    return found


def with_causes(ledger: DataFrame) -> DataFrame:
    """Events with causes, the events their references had when they came, and flags with the dangling bit if one had none."""
    refs = resolved(ledger, forward_only=True).groupBy("seq").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("target_id").isNotNull(), F.struct("ref_index", "target_id")))), lambda x: x["target_id"]).alias("causes"),
        F.max(F.col("target_id").isNull()).alias("dangles"),
    )
    out = ledger.join(refs, "seq", "left")
    flags = F.col("flags") if "flags" in ledger.columns else F.lit(0).cast("bigint")
    return out.withColumns({"causes": F.coalesce("causes", F.array().cast("array<string>")), "flags": F.when(F.col("dangles"), flags.bitwiseOR(F.lit(FLAG_DANGLING))).otherwise(flags)}).drop("dangles")


def edges(ledger: DataFrame) -> DataFrame:
    """(a, b): event a refers to event b, b wherever it stands."""
    return resolved(ledger).filter("target_id IS NOT NULL").select(F.col("event_id").alias("a"), F.col("target_id").alias("b")).distinct()


#: Layers that are peeled one by one before chains are passed over.
LAYERS = 6


def _peeled(graph: DataFrame, layers: int | None = None) -> tuple[DataFrame, bool]:
    """Edges (a, b) without those of nodes that have no way in or out, until none is left or so many layers are gone; and whether none is left. A round
    drops a layer at least; each is written down, so that the plan doesn't grow."""
    now, k = durable(graph, "graph"), 0
    n = now.count()
    while n and k != layers:
        left = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        left = left.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        now, k = durable(left, "graph"), k + 1
        n, m = now.count(), n
        if n == m:
            return now, True
    return now, not n


def _jumps(steps: DataFrame) -> list[DataFrame]:
    """steps: one way (v, w) out of each node that has no other. Where 1, 2, 4, ... of these lead from each node; who comes to a node without one
    stays there. The last table says where every way ends: as many rounds as its length doubles in."""
    n, k = steps.count(), 0
    tables = [durable(steps, "jumps")]
    while n:
        now = tables[-1]
        ahead = now.select(F.col("v").alias("w"), F.col("w").alias("__next"))
        new = durable(now.join(ahead, "w", "left").select("v", F.coalesce("__next", "w").alias("w"), F.col("__next").isNotNull().alias("moved")), "jumps")
        moved, k = bool(new.filter("moved").head(1)), k + 1
        tables.append(new.select("v", "w"))
        if not moved or 2**k > n:  # beyond that, who still moves runs in a ring
            break
    return tables


def cyclic_core(graph: DataFrame) -> DataFrame:
    """Edges (a, b) that lie on cycles, and perhaps some between them. Empty if there is no cycle.

    What is shallow goes by a few layers. Long chains are not peeled link by link: nodes with one way out are passed over by jumps that double, and
    only the graph of the others, from branch to branch, is peeled. The links of the ways that are left are then gathered by the same jumps."""
    every, settled = _peeled(graph.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), LAYERS)
    if settled:
        return every
    only = every.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("w")).filter("n = 1 AND w <> a").select(F.col("a").alias("v"), "w")
    tables = _jumps(only)
    steps, last = tables[0], tables[-1].select(F.col("v").alias("b"), F.col("w").alias("end"))
    # Whose way out of single steps never ends is in a ring or leads to one; the nodes of a ring are those that come up after so many steps.
    endless = last.join(steps.select(F.col("v").alias("end")), "end", "left_semi")
    ring = endless.select(F.col("end").alias("v")).distinct()
    forks = every.join(steps.select(F.col("v").alias("a")), "a", "left_anti")
    ended = forks.join(endless.select("b"), "b", "left_anti").join(last, "b", "left").select("a", "b", F.coalesce("end", "b").alias("end"))
    ended = durable(ended, "forks")
    core, _ = _peeled(ended.select("a", F.col("end").alias("b")).distinct())
    kept = durable(ended.join(core.select("a", F.col("b").alias("end")), ["a", "end"], "left_semi").select("a", "b"), "kept")
    inside = durable(kept.select(F.col("b").alias("v")).distinct().join(steps, "v", "left_semi"), "inside")
    for table in reversed(tables[:-1]):
        if not inside.head(1):
            break
        more = inside.join(table, "v").select(F.col("w").alias("v")).join(steps, "v", "left_semi")
        inside = durable(inside.unionByName(more).distinct(), "inside")
    links = steps.join(inside.unionByName(ring).distinct(), "v", "left_semi").select(F.col("v").alias("a"), F.col("w").alias("b"))
    return durable(kept.unionByName(links).distinct(), "core")


def reachable(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that a way from start (column start) leads to. Semi-naive: a round follows only what the last one found."""
    steps = durable(graph.select("a", "b").distinct(), "steps")
    found = durable(starts.join(steps, starts["start"] == steps["a"]).select("start", F.col("b").alias("node")).distinct(), "found")
    front = found
    while front.head(1):
        more = front.join(steps, front["node"] == steps["a"]).select("start", F.col("b").alias("node")).distinct()
        front = durable(more.join(found, ["start", "node"], "left_anti"), "front")
        found = durable(found.unionByName(front), "found")
    return found


def strong_components(graph: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle; two nodes share a component if each leads to the other. Named by its greatest node.

    Colours flow along the edges until each node has the greatest that leads to it; the nodes of a colour that lead back to its
    namesake are one component. What is left is peeled and coloured again."""
    rest, made = cyclic_core(graph), None
    while rest.head(1):
        colour = durable(rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct().withColumn("colour", F.col("node")), "colour")
        changed = True
        while changed:
            into = rest.join(colour, rest["a"] == colour["node"]).groupBy(F.col("b").alias("to")).agg(F.max("colour").alias("came"))
            new = durable(colour.join(into, colour["node"] == into["to"], "left").select("node", "colour", F.greatest("colour", F.coalesce("came", "colour")).alias("now")), "colour")
            changed = bool(new.filter("now <> colour").head(1))
            colour = new.select("node", F.col("now").alias("colour"))
        tails, heads = colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
        own = durable(rest.join(tails, "a").join(heads, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("colour")), "own")
        # Backwards from the namesakes, within the colour.
        found = durable(colour.filter("node = colour"), "found")
        front = found
        while front.head(1):
            back = own.join(front, (own["b"] == front["node"]) & (own["colour"] == front["colour"])).select(own["a"].alias("node"), own["colour"].alias("colour")).distinct()
            front = durable(back.join(found, ["node", "colour"], "left_anti"), "front")
            found = durable(found.unionByName(front), "found")
        some = found.select("node", F.col("colour").alias("component"))
        # A namesake alone is a component only if it leads to itself.
        loops = rest.filter("a = b").select(F.col("a").alias("node"))
        several = some.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
        some = durable(some.join(several, "component", "left_semi").unionByName(some.join(loops, "node", "left_semi")).distinct(), "components")
        made = some if made is None else made.unionByName(some)
        gone = found.select("node")
        rest = cyclic_core(own.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    return made if made is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _closing(in_order: bool):
    """Of the edges of one component those that would close a cycle: one after the other, accepted ones counting (in_order), or each by itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, set[str]] = {}
        for a, b in rows.loc[~rows["asked"], ["a", "b"]].itertuples(index=False):
            after.setdefault(a, set()).add(b)

        def leads(start: str, goal: str) -> bool:
            seen, stack = {start}, [start]
            while stack:
                if (x := stack.pop()) == goal:
                    return True
                new = after.get(x, set()) - seen
                seen |= new
                stack += new
            return False

        refused = []
        for r in rows[rows["asked"]].sort_values(["seq", "ref_index"]).itertuples(index=False):
            if leads(r.b, r.a):
                refused.append((r.seq, r.ref_index))
            elif in_order:
                after.setdefault(r.a, set()).add(r.b)
        return pd.DataFrame(refused, columns=["seq", "ref_index"]).astype({"seq": "int64", "ref_index": "int32"})

    return run


def _judged(ledger: DataFrame, recorded: DataFrame | None, in_order: bool) -> DataFrame:
    """references with target_id, linked (a recorded link) and closes: the reference is not linked and would close a cycle of the
    causes that events had when they came and of the links. Only edges within a strong component can; these
    are judged a component a task, since refusals depend on the ones before."""
    refs = resolved(ledger).withColumn("early", F.coalesce(F.col("target_seq") < F.col("seq"), F.lit(False)))
    if recorded is not None:
        refs = refs.join(recorded.select("event_id", "ref_index", F.lit(True).alias("linked")), ["event_id", "ref_index"], "left")
    refs = durable(refs.withColumn("linked", F.coalesce("linked", F.lit(False)) if recorded is not None else F.lit(False)), "references")
    graph = refs.filter("target_id IS NOT NULL").select(F.col("event_id").alias("a"), F.col("target_id").alias("b"), "seq", "ref_index", (~(F.col("early") | F.col("linked"))).alias("asked"))
    parts = durable(strong_components(graph), "parts")
    inner = graph.join(parts.select(F.col("node").alias("a"), F.col("component").alias("p")), "a").join(parts.select(F.col("node").alias("b"), F.col("component").alias("q")), "b").filter("p = q")
    closing = inner.select("p", "a", "b", "seq", "ref_index", "asked").groupBy("p").applyInPandas(_closing(in_order), "seq bigint, ref_index int").withColumn("closes", F.lit(True))
    return refs.join(closing, ["seq", "ref_index"], "left").withColumn("closes", F.coalesce("closes", F.lit(False)))


def causal_links(ledger: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """A link pass: (event_id, ref_index, target_id) for each reference without a recorded link that has a target, earliest target, in the
    order of the log; a link that would close a cycle is refused."""
    found = _judged(ledger, recorded, in_order=True)
    return found.filter("NOT linked AND target_id IS NOT NULL AND NOT closes").select("event_id", "ref_index", "target_id")


def reference_states(ledger: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """references without a recorded link, with state: dangling (no target), cyclic (a link would close a cycle), pending (a link pass will record it)."""
    state = F.when(F.col("target_id").isNull(), "dangling").when(F.col("closes"), "cyclic").otherwise("pending")
    return _judged(ledger, recorded, in_order=False).filter("NOT linked").select("seq", "event_id", "ref_index", "kind", "target", "target_id", state.alias("state"))


def attributed(effects: DataFrame, ledger: DataFrame) -> DataFrame:
    """effects (chat_jid, msg_id) with the latest event of their message."""
    last = ledger.filter(F.col("msg_id").isNotNull()).groupBy("chat_jid", "msg_id").agg(F.max_by("event_id", "seq").alias("event_id"))
    return effects.join(last, ["chat_jid", "msg_id"], "left")
