"""Intent sets in the layout of one JSON file per set and a summary, as a Spark data source.

``members.write.format("intent_sets")`` streams every set into its own file:
a task holds one intent and the counts of themes.  Files get their names when
the whole job is done, so a lost executor or a repeated task leaves no half
written set, and a set is never seen twice.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Names of the files of a folder of intent sets.
SUMMARY_FILE = "intent_sets_summary.json"
SET_FILE = "intent_set_{:02d}.json"


@dataclass
class WrittenSets(WriterCommitMessage):
    """Set number, number of intents, themes and unnamed file of every set a task wrote."""

    sets: list[tuple[int, int, list[str], str]]


class IntentSetWriter(DataSourceWriter):
    """Rows ``(set_number, pos, intent, theme)`` sorted by set and position, every set in one task."""

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.creation_date = options["creation_date"]
        self.n_sets = int(options["n_sets"])
        self.seed = int(options["seed"])

    def _open(self):
        return fs.FileSystem.from_uri(self.folder)

    def _write_set(self, number: int, rows: Iterator) -> tuple[int, int, list[str], str]:
        files, folder = self._open()
        path = f"{folder}/_{SET_FILE.format(number)}.{uuid.uuid4().hex}"
        themes, total = Counter(), 0
        with files.open_output_stream(path) as out:
            out.write(b'{\n  "intents": [')
            for row in rows:
                out.write(b",\n    " if total else b"\n    ")
                out.write(json.dumps(row["intent"], ensure_ascii=False).encode("utf-8", "replace"))
                themes[row["theme"] or ""] += 1
                total += 1
            about = {"set_number": number, "creation_date": self.creation_date, "seed": self.seed,
                     "theme_distribution": dict(sorted(themes.items())), "total_intents": total}
            out.write(f'\n  ],\n  "metadata": {json.dumps(about, ensure_ascii=False)}\n}}\n'.encode())
        return number, total, sorted(themes), path

    def write(self, iterator):
        _prepare(*self._open())
        return WrittenSets([self._write_set(number, rows) for number, rows in groupby(iterator, key=lambda r: r["set_number"])])

    def commit(self, messages):
        files, folder = self._open()
        _prepare(files, folder)
        written = [s for m in messages if m is not None for s in m.sets]
        found = {s[0] for s in written}
        if len(found) < len(written):
            self.abort(messages)
            raise ValueError("a set came from two tasks")
        total = max([self.n_sets, *found])
        written += [self._write_set(number, iter(())) for number in range(1, total + 1) if number not in found]
        for number, _, _, path in written:
            files.move(path, f"{folder}/{SET_FILE.format(number)}")
        summary = {
            "generation_info": {"total_sets": total, "creation_date": self.creation_date,
                                "intents_per_set": next((n for number, n, _, _ in written if number == 1), 0)},
            "theme_info": sorted({theme for s in written for theme in s[2]}),
            "files": [SET_FILE.format(number) for number in range(1, total + 1)],
        }
        with files.open_output_stream(f"{folder}/{SUMMARY_FILE}") as out:
            out.write(json.dumps(summary, indent=2, ensure_ascii=False).encode())

    def abort(self, messages):
        files, _ = self._open()
        for message in messages:
            for _, _, _, path in message.sets if message is not None else []:
                if files.get_file_info(path).type != fs.FileType.NotFound:
                    files.delete_file(path)


def _prepare(files: fs.FileSystem, folder: str) -> None:
    files.create_dir(folder, recursive=True)


class IntentSetSource(DataSource):
    """Write-only; ``readers.load_intent_sets`` reads the folder."""

    @classmethod
    def name(cls):
        return "intent_sets"

    def writer(self, schema, overwrite):
        return IntentSetWriter(self.options)


def export_intent_set_files(members: DataFrame, folder: str, creation_date: str, n_sets: int, seed: int = 42) -> None:
    """``members(set_number, pos, intent, theme)`` as one file per set and a summary.

    Sets without intents get a file too, null themes count as empty ones.  The
    folder must be one that every executor can reach.  A set is written by one
    task, since it is one file; ``export_intent_sets`` writes a set by many.
    """
    members.sparkSession.dataSource.register(IntentSetSource)
    rows = members.select("set_number", "pos", "intent", "theme").repartition("set_number").sortWithinPartitions("set_number", "pos")
    rows.write.format("intent_sets").mode("append").options(
        path=folder, creation_date=creation_date, n_sets=n_sets, seed=seed).save()
