"""Tables that change together: several writes become visible at once, or not at all.

A commit is a small file that names the data files of every table. Writes add
files that no commit names yet; a deletion rewrites only the files that hold
rows to delete. The next commit, moved into place in one step, shows all of it.
Whoever fails before that leaves all tables as they were, and files that no
commit names are never read.

One writer at a time is expected; a second one whose base has changed meanwhile
is refused. The list of files is held by the driver, as for any scan.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FILE = "_metadata.file_path"


def plain(file: str) -> str:
    """A file's path without the scheme and host of its store."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", file)


@dataclass
class Tables:
    """A folder of tables with its commits."""

    spark: SparkSession
    root: str

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def system(self):
        return self.path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        files, folder = self.system(), self.path("commits")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Per table its layout and files."""
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(str(self.path(f"commits/{version:012d}.json").toString()), wholetext=True)
        return json.loads(lines.first().value)

    def names(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one by default."""
        return self.rows_of(self.manifest(version)[name])

    def rows_of(self, entry: dict) -> DataFrame:
        layout = T.StructType.fromJson(entry["layout"])
        if not entry["files"]:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(*entry["files"])

    def change(self) -> Change:
        """Writes that become visible when the ``with`` block ends without an error."""
        version = self.version()
        return Change(self, version, self.manifest(version))


@dataclass
class Change:
    """What a transaction has written so far."""

    tables: Tables
    base: int
    entries: dict[str, dict]
    done: bool = field(default=False)

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()

    def read(self, name: str) -> DataFrame:
        """A table as this change leaves it."""
        return self.tables.rows_of(self.entries[name])

    def written(self, name: str, rows: DataFrame) -> list[str]:
        """New files with the rows."""
        folder = self.tables.path(f"data/{name}/{uuid.uuid4().hex}")
        rows.write.parquet(folder.toString())
        found = self.tables.system().listStatus(folder)
        return sorted(s.getPath().toString() for s in found if s.getPath().getName().startswith("part-") and s.getLen())

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table, by column name; the first ones give it its layout."""
        entry = self.entries.get(name)
        if entry is None:
            entry = {"layout": json.loads(rows.schema.json()), "files": []}
        columns = [f["name"] for f in entry["layout"]["fields"]]
        if set(columns) != set(rows.columns):
            raise ValueError(f"The columns of {name} are {', '.join(columns)}.")
        types = {f.name: f.dataType for f in T.StructType.fromJson(entry["layout"]).fields}
        files = self.written(name, rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in columns]))
        self.entries = self.entries | {name: entry | {"files": entry["files"] + files}}

    def delete(self, name: str, condition: Column) -> int:
        """Delete the rows for which a condition is true; only files with such rows are rewritten. Returns their number."""
        entry = self.entries[name]
        if not entry["files"]:
            return 0
        gone = F.coalesce(condition, F.lit(False))
        rows = self.tables.rows_of(entry)
        hits = rows.where(gone).groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("n"))
        counts = {unquote(plain(row.file)): row.n for row in hits.collect()}  # one row per file at most
        touched = [f for f in entry["files"] if plain(f) in counts]
        if len(touched) != len(counts):
            raise ValueError(f"Files of {name} could not be told apart.")
        if touched:
            rest = [f for f in entry["files"] if plain(f) not in counts]
            files = self.written(name, self.tables.rows_of(entry | {"files": touched}).where(~gone))
            self.entries = self.entries | {name: entry | {"files": rest + files}}
        return sum(counts.values())

    def commit(self) -> int:
        """Show everything that was written. Refused if another commit came in between."""
        if self.done:
            raise ValueError("This change is committed already.")
        files, number = self.tables.system(), self.base + 1
        target, aside = self.tables.path(f"commits/{number:012d}.json"), self.tables.path(f"commits/.{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(self.entries), "utf-8"))
        stream.close()
        if self.tables.version() != self.base or files.exists(target) or not files.rename(aside, target):
            files.delete(aside, False)
            raise ValueError("The tables were changed by someone else meanwhile.")
        self.done = True
        return number
