"""Deletion of documents in phases, by a journal: each phase may fail, be repeated or be taken up by another job.

A request goes through marked, chunks, file and gone. Every step is appended to the journal when it is done, so the state of
a document is its journal's last entry. What a phase does may be done again without harm. If a phase fails, the document is
`ready` again, with a message, and its journal entry says so; a later request starts over.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

#: Phases in order. The first marks the documents, the last takes them out of their table.
PHASES = ("marked", "chunks", "file", "gone")
RESTORED = "restored"
JOURNAL = "document_id string, phase string, message string, at timestamp, seq long"


def position(journal: DataFrame) -> DataFrame:
    """The last entry of each document: document_id, phase, message, at."""
    last = journal.groupBy("document_id").agg(F.max_by(F.struct("phase", "message", "at"), "seq").alias("e"))
    return last.select("document_id", "e.*")


class Deletion:
    """Deletes documents of a table; `steps` say how chunks and files of some documents (document_id, path) are removed.

    `journal` is the path of the journal's Parquet table, in a shared folder. `documents` has document_id, status,
    error_message and stored_path. A step gets a table of documents and removes what belongs to them; it may raise, and may
    have removed a part of it.
    """

    def __init__(self, journal: str, chunks: Callable[[DataFrame], None], file: Callable[[DataFrame], None]) -> None:
        self.path, self.steps = journal, {"chunks": chunks, "file": file}

    def entries(self, documents: DataFrame) -> DataFrame:
        spark = documents.sparkSession
        try:
            return spark.read.schema(JOURNAL).parquet(self.path)
        except Exception as error:  # noqa: BLE001  a journal that nobody has written to is empty
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], JOURNAL)

    def _append(self, documents: DataFrame, ids: DataFrame, phase: str, at: datetime, message: str | None = None) -> None:
        seq = self.entries(documents).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        told = ids.select("document_id", F.lit(phase).alias("phase"), F.lit(message).cast("string").alias("message"), F.lit(at).cast("timestamp").alias("at"), F.lit(seq).cast("long").alias("seq"))
        stored(told).write.mode("append").parquet(self.path)

    def request(self, documents: DataFrame, ids: DataFrame, at: datetime) -> None:
        """Mark documents for deletion: those that are there, aren't being processed, and aren't on their way out already."""
        state = position(self.entries(documents)).filter(F.col("phase") != RESTORED).select("document_id")
        asked = documents.join(ids.select("document_id").distinct(), "document_id", "left_semi").filter("status <> 'processing'")
        self._append(documents, asked.join(state, "document_id", "left_anti"), "marked", at)

    def table(self, documents: DataFrame) -> DataFrame:
        """The documents as the journal leaves them: gone, `deleting`, or `ready` with a message."""
        state = position(self.entries(documents)).select("document_id", F.col("phase").alias("_phase"), F.col("message").alias("_message"))
        out = documents.join(state, "document_id", "left").filter(F.coalesce(F.col("_phase") != "gone", F.lit(True)))
        restored = F.col("_phase") == RESTORED
        status = F.when(F.col("_phase").isNull(), F.col("status")).when(restored, "ready").otherwise("deleting")
        message = F.when(F.col("_phase").isNull(), F.col("error_message")).when(restored, F.col("_message"))
        return out.withColumns({"status": status, "error_message": message}).select(*documents.columns)

    def run(self, documents: DataFrame, at: datetime) -> bool:
        """Carry all marked documents on from where their journal stands; returns whether all of them are gone.

        A failing step restores the documents that it was for; those that other phases wait for go on.
        """
        fine = True
        for phase, following in zip(PHASES, PHASES[1:], strict=False):
            due = stored(position(self.entries(documents)).filter(F.col("phase") == phase).join(documents.select("document_id", F.col("stored_path").alias("path")), "document_id", "left").select("document_id", "path"))
            if due.isEmpty():
                continue
            step = self.steps.get(following)
            try:
                if step is not None:
                    step(due)
            except Exception as error:  # noqa: BLE001  whatever a store raises restores the documents
                self._append(documents, due, RESTORED, at, f"删除失败: {error}")
                fine = False
                continue
            self._append(documents, due, following, at)
        return fine


def history(journal: DataFrame) -> DataFrame:
    """Each document's entries in order: document_id, n, phase, message."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("seq"))
    return journal.select("document_id", n.alias("n"), "phase", "message")
