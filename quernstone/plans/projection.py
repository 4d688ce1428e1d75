"""Views kept up to date from a checkpoint: only what changed since is folded again.

A view is a pure function of the log; its row of a key depends on the events of that key alone. So an advance reads the
events after the checkpoint for their keys, folds all events of these keys, and replaces their rows: as exact as a rebuild. The new rows and
the checkpoint become current in one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import decode, views
from quernstone.sources.catalog import Catalog

_MESSAGE, _CHAT = ["chat_jid", "msg_id"], ["chat_jid"]
#: View -> its table's key, and the events' columns that make it, for a log without raw bytes.
KEYS = {
    "chats": (["jid"], _CHAT), "groups": (["jid"], _CHAT), "polls": (_MESSAGE, _MESSAGE), "poll_votes": (["chat_jid", "poll_msg_id"], _MESSAGE),
    "starred": (_MESSAGE, _MESSAGE), "messages": (_MESSAGE, _MESSAGE), "message_payload_purges": (_MESSAGE, _MESSAGE),
}
#: The same for a log as it is written: what is in the raw bytes alone (polls, stars) is kept up by chat, contacts by their id, which is the event's chat.
WRITTEN_KEYS = {
    "messages": (_MESSAGE, _MESSAGE), "message_locations": (_MESSAGE, _MESSAGE), "message_payload_purges": (_MESSAGE, _MESSAGE), "chats": (["jid"], _CHAT), "contacts": (["jid"], _CHAT), "groups": (["jid"], _CHAT),
    "group_participants": (["group_jid"], _CHAT), "polls": (_CHAT, _CHAT), "poll_votes": (_CHAT, _CHAT), "starred": (_CHAT, _CHAT), "call_events": (_CHAT, _CHAT),
}
#: Events that say something of all rows of a view: it is made anew.
WHOLE = {"contacts": "clear_system_names"}
#: Keys that go to the scan of the log and of the view; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


class Truncated(RuntimeError):
    """The log lacks events that a view has, or should have."""


def advanced(view: str, table: DataFrame, log: DataFrame, after: int, upto: int) -> DataFrame:
    """The view's rows at event upto, from those at event after."""
    key, own = (WRITTEN_KEYS if decode.written(log) else KEYS)[view]
    known = log.filter(F.col("seq") <= upto)
    if view in WHOLE and known.filter((F.col("seq") > after) & (F.col("event_type") == WHOLE[view])).head(1):
        return views.VIEWS[view](known)
    changed = known.filter(F.col("seq") > after).select(*own).distinct()
    changed = F.broadcast(changed) if changed.count() <= BROADCAST_KEYS else changed
    more = known.filter(F.col("event_type") == WHOLE[view]) if view in WHOLE else None
    mine = known.join(changed, own, "left_semi")
    made = views.VIEWS[view](mine if more is None else mine.unionByName(more))
    stale = changed.select(*[F.col(a).alias(b) for a, b in zip(own, key, strict=True)])
    return table.join(stale, key, "left_anti").unionByName(made, allowMissingColumns=True)


def advance(catalog: Catalog, names: list[str], log: DataFrame, target: int | None = None) -> dict[str, tuple[int, int]]:
    """Brings views of the catalogue to event target (the head of the log by default): view -> (from, to), each from its own checkpoint, however
    uneven these are. All become current together, and tables of other views stay as they are.

    A checkpoint beyond the target, or a stretch of the log without any event, is an error, and nothing changes; nor does it if another writer
    was faster (Conflict)."""
    head = log.agg(F.max("seq")).first()[0] or 0
    upto = head if target is None else target
    moved, tables, state = {}, {}, catalog.state()
    for name in names:
        after = state["checkpoints"].get(name, 0)
        if after > upto:
            raise Truncated(f"{name}: checkpoint {after} is ahead of target {upto}")
        if after < upto and not log.filter((F.col("seq") > after) & (F.col("seq") <= upto)).head(1):
            raise Truncated(f"{name}: no events in ({after}, {upto}]")
        moved[name] = (after, upto)
        if after < upto:
            tables[name] = advanced(name, catalog.table(name), log, after, upto)
    if tables:
        catalog.promote(catalog.write_snapshot(tables), checkpoints={name: upto for name in names}, since=state)
    return moved
