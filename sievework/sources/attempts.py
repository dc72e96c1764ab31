"""Files that a job writes all or none of: tasks write attempts, the driver moves the winners."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """A task's finished files, in order, and its partition."""

    files: list[str]
    part: int


class Attempts:
    """A writer's side of the contract: files go into a hidden folder under names of their attempt, and on commit to ``part-<partition>-<nth>-<job>``.

    So a failed, repeated or speculative attempt leaves nothing, and two jobs' files never share a name.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _open(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/_attempts-{self.job}"

    def attempt(self):
        """(store, name of this task's attempt, its partition); the folder is there."""
        from pyspark import TaskContext

        store, _, attempts = self._open()
        store.create_dir(attempts, recursive=True)
        context = TaskContext.get()
        return store, f"{attempts}/{context.partitionId():05d}-{context.taskAttemptId()}", context.partitionId()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root, attempts = self._open()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.is_file:
                    store.delete_file(old.path)
        for m in messages:
            for nth, file in enumerate(m.files if m is not None else []):
                store.move(file, f"{root}/part-{m.part:05d}-{nth:05d}-{self.job}{self.suffix}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, _, attempts = self._open()
        if store.get_file_info(attempts).type == fs.FileType.Directory:
            store.delete_dir(attempts)


def data_files(path: str) -> list[str]:
    """The file, or the visible files of the folder, in order of their names."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return [f.path for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]
