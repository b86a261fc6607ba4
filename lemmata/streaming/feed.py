"""A stream of changes that keeps a session up to date, batch by batch.

A change is a fact of the stream's type with a column ``op``, ``insert`` or
``retract``. Each micro-batch inserts, retracts and fires, and hands the session
to ``each``, so that queries give what a session fed at once would give.

With ``store``, a folder that outlives the driver, the session is written after
each batch and read again from there, which also keeps its plan short. A feed
that starts on a ``store`` with content goes on with the session in it: a batch
that was stored but not yet committed by the stream comes again and is skipped.
Without it a restarted driver has only what it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.session import Session
from ..operators.store import stored
from ..sources.durability import load, save


class Feed:
    """Holds the session that the micro-batches advance."""

    def __init__(self, session: Session, type: str, each: Callable[[Session, int], None] | None = None, cancelling: bool = False, store: str | None = None):
        self.session, self.type, self.each, self.cancelling = session, type, each, cancelling
        self.store, self.last = store and store.rstrip("/"), -1
        if self.store and (kept := self._kept()):
            self.last = max(kept)
            self._restore()

    def batch(self, changes: DataFrame, epoch: int) -> None:
        if epoch <= self.last:  # a batch that was already applied comes again after a restart
            return
        changes = stored(changes)
        facts = changes.drop("op")
        s = self.session.insert(self.type, facts.where(changes["op"] == "insert"))
        if not changes.where(F.col("op") == "retract").isEmpty():
            s = s.retract(self.type, facts.where(changes["op"] == "retract"))
        self.session = s.fire(self.cancelling)
        self.last = epoch
        if self.store:
            save(self.session, f"{self.store}/{epoch}", with_rulebase=False)
            self._restore()
            for old in self._kept():
                if old < epoch - 1:
                    self._files()[0].delete(self._path(f"{self.store}/{old}"), True)
        if self.each:
            self.each(self.session, epoch)

    def _restore(self) -> None:
        s = self.session
        found = load(s.spark, f"{self.store}/{self.last}", s.rulebase)
        self.session = replace(s, base=found.base, state=found.state, serial=found.serial, pending=(), cache={})

    def _path(self, path: str):
        return self.session.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        path = self._path(self.store)
        return path.getFileSystem(self.session.spark._jsc.hadoopConfiguration()), path

    def _kept(self) -> list[int]:
        """Batches whose session was stored whole: the manifest comes last."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n) for n in names if n.isdigit() and fs.exists(self._path(f"{self.store}/{n}/manifest/_SUCCESS"))]

    def start(self, changes: DataFrame, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        """Attaches to a streaming DataFrame of changes."""
        writer = changes.writeStream.foreachBatch(self.batch).outputMode("append")
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
