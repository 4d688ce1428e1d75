"""Messages as a JSON file for people and other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quernstone.operators.reads import list_messages

LIMIT = 1000


def export(messages: DataFrame, path: str, *, limit: int = LIMIT, **filters) -> None:
    """The first messages by time, oldest first, an object a line, in a folder of one file that replaces an older one. Only as many rows as the limit meet in its task;
    with limit 0 all are written, in ordered files."""
    out = list_messages(messages, limit=limit, ascending=True, **filters)
    (out.coalesce(1) if limit > 0 else out).write.mode("overwrite").json(path)
