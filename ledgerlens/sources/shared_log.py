"""Files in a folder that driver and executors share, through Spark's own file systems, and a log of numbered records in it.

Writers of one log may run at once. A writer claims a number by a file of its own name and then lists the claims: if another
writer claims the same number, it gives its claim up, waits and takes a later one. Of two writers that claim one number the
later one sees the other's claim, since it lists after writing, so no number is given twice; a record is written beside the
log and moved into it, so readers see whole records only. A writer that dies leaves a number unused and nothing else.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class SharedFolder:
    """Texts and files by their path below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = "") -> Any:
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Names of what a folder holds, in order; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        source = self._fs.open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def write(self, name: str, text: str, replace: bool = True) -> None:
        out = self._fs.create(self.path(name), replace)
        out.write(text.encode())
        out.close()

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self.path(to).getParent())
        if not self._fs.rename(self.path(name), self.path(to)):
            raise FileExistsError(f"{self.root}/{to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def put(self, local: str, folder: str) -> None:
        self._fs.mkdirs(self.path(folder))
        self._fs.copyFromLocalFile(self._path(f"file://{local}"), self.path(folder))

    def fetch(self, name: str, into: str) -> None:
        self._fs.copyToLocalFile(False, self.path(name), self._path(f"file://{into}"), True)


class SharedLog:
    """A log of records, one file each: `records/000007.json`."""

    def __init__(self, spark: SparkSession, root: str, ending: str = "json"):
        self.folder, self.ending = SharedFolder(spark, root), ending

    @property
    def records(self) -> str:
        """What Spark's readers read."""
        return f"{self.folder.root}/records"

    def numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.folder.names("records")]

    def claim(self) -> int:
        """A number above all others that no other writer gets."""
        own = uuid.uuid4().hex
        while True:
            claims = self.folder.names("claims")
            number = 1 + max([int(n.split("-")[0]) for n in claims] + self.numbers(), default=0)
            name = f"claims/{number:06d}-{own}"
            self.folder.write(name, "")
            if not any(n.startswith(f"{number:06d}-") and not n.endswith(own) for n in self.folder.names("claims")):
                return number
            self.folder.delete(name)
            time.sleep(random.random() * 0.2)

    def append(self, text: Callable[[int], str]) -> int:
        """Adds what `text` makes of the record's number, and returns the number."""
        number = self.claim()
        written = f"started/{number:06d}-{uuid.uuid4().hex}"
        self.folder.write(written, text(number))
        self.folder.move(written, f"records/{number:06d}.{self.ending}")
        return number

    def texts(self) -> list[str]:
        """All records in order; a log of experiments is small."""
        return [self.folder.read(f"records/{n}") for n in self.folder.names("records")]
