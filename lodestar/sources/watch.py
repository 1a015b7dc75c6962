"""A streaming source of changed files: what differs between two listings of a tree.

The driver only lists the top of the tree; each micro-batch has a part for every folder there, and the executors list these
and compare them with what they found in the micro-batch before.  A part's listing is a file of its own beside the
checkpoint, named by round, so a batch that is run again compares with the same listing; older rounds go.  Every change
comes at least once, and once if no batch is run again.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import HARD

NAME = "file_changes"
SCHEMA = "path string, kind string, size_bytes long, last_modified long, ts timestamp, event_id long"
#: Rounds whose listings are kept behind the newest.
KEPT = 2


def listing(root: str, top: str) -> dict[str, list[int]]:
    """{path: [size, time in milliseconds]} of the files of one part: those below a folder at the top of the tree, or the
    files at the top itself.  Links to folders aren't followed; what goes meanwhile isn't there."""
    found: dict[str, list[int]] = {}
    stack = [f"{root}/{top}" if top else root]
    while stack:
        folder = stack.pop()
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        stack += [e.path] if top and e.name not in HARD else []
                    elif e.is_file():
                        stat = e.stat()
                        found[os.path.relpath(e.path, root)] = [stat.st_size, stat.st_mtime_ns // 1_000_000]
        except OSError:
            continue
    return found


def difference(before: dict[str, list[int]], now: dict[str, list[int]]) -> list[tuple[str, str, int | None, int | None]]:
    """(path, kind, size, time) of what differs, by path."""
    out = [(p, "created" if p not in before else "changed", *now[p]) for p in now if before.get(p) != now[p]]
    return sorted(out + [(p, "deleted", None, None) for p in before if p not in now])


class Part(InputPartition):
    def __init__(self, top: str, round_: int):
        self.top, self.round = top, round_


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"].removeprefix("file:").rstrip("/"), options["state"].removeprefix("file:").rstrip("/")
        self.first = options.get("existing", "false").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A new round each time that the stream asks: what differs is only known where the parts are listed."""
        rounds = [int(n.split("-")[1]) for n in os.listdir(self.state) if n.startswith("round-")] if os.path.isdir(self.state) else []
        return {"round": max(rounds, default=0) + 1}

    def _tops(self) -> list[str]:
        """Folders at the top, those of the rounds before among them, and "" for the files there."""
        now = {e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in HARD}
        known = set()
        if os.path.isdir(self.state):
            for name in os.listdir(self.state):
                if name.startswith("top-"):
                    with open(f"{self.state}/{name}") as f:
                        known.add(f.read())
        return sorted(now | known | {""})

    def partitions(self, start: dict, end: dict) -> list[Part]:
        os.makedirs(self.state, exist_ok=True)
        tops = self._tops()
        for top in tops:
            self._put(f"top-{self._key(top)}", top)
        os.makedirs(f"{self.state}/round-{end['round']}", exist_ok=True)
        return [Part(top, end["round"]) for top in tops]

    @staticmethod
    def _key(top: str) -> str:
        return hashlib.sha256(top.encode()).hexdigest()[:24]

    def _put(self, name: str, text: str) -> None:
        path = f"{self.state}/{name}"
        own = f"{path}.{os.getpid()}-{time.monotonic_ns()}"
        with open(own, "w") as f:
            f.write(text)
        os.replace(own, path)

    def _before(self, part: Part) -> dict[str, list[int]] | None:
        """The newest listing of a part from a round before this one."""
        rounds = sorted((int(n.split("-")[1]) for n in os.listdir(self.state) if n.startswith("round-")), reverse=True)
        for r in rounds:
            path = f"{self.state}/round-{r}/{self._key(part.top)}"
            if r < part.round and os.path.exists(path):
                with open(path) as f:
                    return json.load(f)
        return None

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime

        before, now = self._before(partition), listing(self.root, partition.top)
        self._put(f"round-{partition.round}/{self._key(partition.top)}", json.dumps(now))
        # A tree that is seen for the first time is the start, unless what is there is asked for; a folder that comes later
        # is all new.
        start = before is None and partition.round == 1 and not self.first
        at = datetime.datetime.now(datetime.UTC)
        for i, (path, kind, size, modified) in enumerate([] if start else difference(before or {}, now)):
            yield path, kind, size, modified, at, i

    def commit(self, end: dict) -> None:
        import shutil

        for name in os.listdir(self.state):
            if name.startswith("round-") and int(name.split("-")[1]) <= end["round"] - KEPT:
                shutil.rmtree(f"{self.state}/{name}", ignore_errors=True)


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes")`` with the options path, a folder that all executors reach, and state, one
    for the listings; with existing, what is there at first comes as created."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:  # noqa: N802
        return ChangeReader(dict(self.options))


def changed_files(spark: SparkSession, root: str, state: str, existing: bool = False) -> DataFrame:
    """The stream of changes of a tree, with paths below root."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format(NAME).option("state", state).option("existing", str(existing).lower()).load(root)
