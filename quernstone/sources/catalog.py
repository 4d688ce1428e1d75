"""Tables on disk: schemas, immutable snapshots behind numbered manifests, and tables written to end a lineage.

A snapshot is a folder of some tables that is never written again. A manifest names the folder of each table, so that a snapshot of one table
shares all others with the one before. Manifests are numbered, and each is created only if it isn't there: of two writers
that start from the same one, one fails and changes nothing. Readers take the last one: they see the old tables or the new ones, never a mixture.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2

#: Table -> DDL.
SCHEMAS = {
    "chats": "jid string, kind string, name string, last_message_ts bigint, archived boolean, pinned boolean, muted_until bigint, unread boolean, unread_count int",
    "contacts": "jid string, phone string, push_name string, full_name string, first_name string, business_name string, system_name string, updated_at bigint",
    "contact_aliases": "jid string, alias string, notes string, updated_at bigint",
    "contact_tags": "jid string, tag string, updated_at bigint",
    "groups": "jid string, name string, owner_jid string, created_ts bigint, is_parent boolean, linked_parent_jid string, left_at bigint, updated_at bigint",
    "group_participants": "group_jid string, user_jid string, role string, updated_at bigint",
    "messages": "rowid bigint, chat_jid string, chat_name string, msg_id string, sender_jid string, sender_name string, ts bigint, from_me boolean, text string, display_text string, quoted_msg_id string, quoted_sender_jid string, is_forwarded boolean, forwarding_score int, reaction_to_id string, reaction_emoji string, media_type string, media_caption string, filename string, mime_type string, direct_path string, media_key binary, file_sha256 binary, file_enc_sha256 binary, file_length bigint, local_path string, downloaded_at bigint, media_unavailable_at bigint, revoked boolean, deleted_for_me boolean, deleted_at bigint, deletion_reason string, payload_purged_at bigint, edited boolean, edited_ts bigint, buttons array<struct<type:string,display_text:string,id:string,url:string,phone_number:string,description:string,response_type:string,index:int>>",
    "message_payload_purges": "chat_jid string, msg_id string, purged_at bigint, deleted_at bigint, deletion_reason string",
    "message_local_media_aliases": "chat_jid string, msg_id string, local_path string, downloaded_at bigint",
    "status_messages": "msg_id string, ts bigint, from_me boolean, sender_jid string, sender_name string, text string, media_type string, media_caption string, filename string, mime_type string, direct_path string, media_key binary, file_sha256 binary, file_enc_sha256 binary, file_length bigint, background_color string, font int",
    "starred": "chat_jid string, msg_id string, sender_jid string, from_me boolean, starred_at bigint",
    "message_locations": "chat_jid string, msg_id string, latitude double, longitude double, name string, address string, is_live boolean",
    "polls": "chat_jid string, msg_id string, sender_jid string, question string, options array<string>, selectable_count int, created_ts bigint",
    "poll_votes": "chat_jid string, poll_msg_id string, voter_jid string, vote_msg_id string, selected array<string>, unknown_hashes array<string>, ts bigint",
    "call_events": "rowid bigint, chat_jid string, chat_name string, sender_jid string, sender_name string, call_id string, msg_id string, event_type string, direction string, media string, outcome string, reason string, call_type string, duration_secs bigint, ts bigint, participants array<struct<jid:string,outcome:string>>",
    "ledger_events": "seq bigint, event_id string, source string, event_type string, message_key string, chat_jid string, msg_id string, sender_jid string, server_ts bigint, event_ts bigint, received_at bigint, raw_hash string, parser_version string, rules_version string, dedup_key string, refs array<struct<kind:string,target:string>>, causes array<string>, batch_id bigint, flags bigint, snapshot string",
    "ledger_raw": "event_id string, encoding string, raw_bytes binary",
    "ledger_causal_links": "event_id string, ref_index int, target_id string",
    "projector_checkpoints": "view string, last_seq bigint, projector_version string, updated_at bigint",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conformed(df: DataFrame, table: str) -> DataFrame:
    """df in the table's columns and types, missing ones null: older snapshots need no other migration."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of this machine if Spark runs in this process alone, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return named.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder of spark.checkpoint.dir and read back: iterations end their lineage here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file of that name and text, whole or not at all; False if there is one already, which stays."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    new = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".new-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    # Written whole beside it, then given its name; a rename without overwriting fails if the name is taken.
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(new, target, how)
    except Py4JJavaError:
        fs.delete(new, False)
        if fs.exists(target):
            return False
        raise
    return True


def last_number(spark: SparkSession, folder: str) -> int:
    """The greatest number that a file of the folder has as its name (numbered), 0 without any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d{12}\.json", n)), default=0)


def numbered(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}.json"


class Conflict(RuntimeError):
    """Another writer changed the catalogue in the meantime."""


class Catalog:
    """Tables of one account below a base folder of any file system that Spark reads. Read-only unless told otherwise.

    One small file, the last of ``manifests``, names the folder of each table, those before the last promotion, each view's checkpoint and mode.
    What a reader sees belongs together. A writer's change is a manifest with the next number; ``Conflict`` if there is one already.
    Rows that a state file of version 1 (``STATE``, one snapshot for all tables) names are still read."""

    def __init__(self, spark: SparkSession, base: str, *, writable: bool = False):
        if "?" in base or "#" in base:
            raise ValueError("a base path can't hold ? or #")
        self.spark, self.base, self.writable = spark, base.rstrip("/"), writable

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return numbered(f"{self.base}/manifests", number)

    def _last(self) -> int:
        """The number of the last manifest, 0 without any."""
        return last_number(self.spark, f"{self.base}/manifests")

    def state(self) -> dict:
        """number (of the manifest), snapshot, tables, those before (backup, backup_tables), checkpoints, modes."""
        jvm, fs = self._fs()
        empty = {"number": 0, "snapshot": None, "backup": None, "tables": {}, "backup_tables": {}, "checkpoints": {}, "backup_checkpoints": {}, "modes": {}}
        number = self._last()
        if number:
            return empty | json.loads(self.spark.read.text(self._manifest(number), wholetext=True).first()[0]) | {"number": number}
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/STATE")):
            return empty | json.loads(self.spark.read.text(f"{self.base}/STATE", wholetext=True).first()[0])
        return empty

    def _write_state(self, now: dict, **changes) -> None:
        """The manifest after now, created only if nobody else has."""
        if not self.writable:
            raise PermissionError("the catalogue is read-only")
        value = json.dumps({k: v for k, v in (now | changes).items() if k != "number"})
        if not create_once(self.spark, self._manifest(now["number"] + 1), value):
            raise Conflict(f"manifest {now['number'] + 1} of {self.base} is there already")

    def current(self) -> str | None:
        """The snapshot that is read."""
        return self.state()["snapshot"]

    def checkpoint(self, view: str) -> int:
        """The last event that the view has; 0 without one."""
        return self.state()["checkpoints"].get(view, 0)

    def set_checkpoint(self, view: str, seq: int) -> None:
        now = self.state()
        self._write_state(now, checkpoints=now["checkpoints"] | {view: seq})

    def mode(self, view: str) -> str:
        """shadow, unless it has been set."""
        return self.state()["modes"].get(view, "shadow")

    def set_mode(self, view: str, mode: str) -> None:
        now = self.state()
        self._write_state(now, modes=now["modes"] | {view: mode})

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        """The table as it is read now, or of one snapshot; without rows if none has it."""
        now = self.state() if snapshot is None else {}
        snapshot = snapshot or now["tables"].get(name) or (now["snapshot"] if not now["tables"] else None)
        jvm, fs = self._fs()
        if snapshot is None or not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/{snapshot}/{name}")):
            return self.spark.createDataFrame([], schema(name))
        return conformed(self.spark.read.parquet(f"{self.base}/{snapshot}/{name}"), name)

    def write_snapshot(self, tables: dict[str, DataFrame], snapshot: str | None = None) -> str:
        """Writes tables into a new snapshot, which nobody reads before it is promoted."""
        if not self.writable:
            raise PermissionError("the catalogue is read-only")
        snapshot = snapshot or f"s-{uuid.uuid4().hex}"
        for name, df in tables.items():
            conformed(df, name).write.parquet(f"{self.base}/{snapshot}/{name}")
        return snapshot

    def _tables_of(self, snapshot: str) -> list[str]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{snapshot}")
        return [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory()] if fs.exists(folder) else []

    def promote(self, snapshot: str, violations: DataFrame | None = None, *, diff: DataFrame | None = None, checkpoints: dict[str, int] | None = None, since: dict | None = None) -> None:
        """Makes the snapshot's tables the current ones, with its views' checkpoints; all other tables stay those they are. What was read before is
        remembered. Refused if an invariant is violated, or rows differ that should not (diff: rows of a comparison with what is read
        now). since: the state that the snapshot was made from; Conflict if the catalogue has changed after it."""
        if violations is not None and violations.head(1):
            raise ValueError("the snapshot violates an invariant")
        if diff is not None and diff.head(1):
            raise ValueError("the snapshot differs from what is read now")
        now = since or self.state()
        before = now["tables"] or dict.fromkeys(self._tables_of(now["snapshot"]) if now["snapshot"] else [], now["snapshot"])
        self._write_state(
            now, snapshot=snapshot, backup=now["snapshot"], tables=before | dict.fromkeys(self._tables_of(snapshot), snapshot), backup_tables=before, checkpoints=now["checkpoints"] | (checkpoints or {}),
            backup_checkpoints=now["checkpoints"], modes=now["modes"] | dict.fromkeys(checkpoints or {}, "active"),
        )

    def rollback(self) -> str:
        """Reads the tables before the last promotion again, with their checkpoints."""
        now = self.state()
        if not now["backup"]:
            raise ValueError("there is no snapshot to go back to")
        self._write_state(now, snapshot=now["backup"], backup=now["snapshot"], tables=now["backup_tables"], backup_tables=now["tables"], checkpoints=now["backup_checkpoints"], backup_checkpoints=now["checkpoints"])
        return now["backup"]
