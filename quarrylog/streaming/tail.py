"""A growing text file as a stream of whole lines; a tail without its newline waits for the next read, or for the seal."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .capture import SCHEMA

STEP = 8 << 20


class TailReader(SimpleDataSourceStreamReader):
    """Runs on the driver, which holds the capture. A file that shrank is a new source: its generation goes up.

    The capture is sealed by a file beside it with `.sealed` at the end of its name. Once all is read, what stands after the
    last newline becomes a line and the seal's row follows; after that nothing more is read of this generation.
    """

    def __init__(self, path: str, buffer: str | None = None):
        self.path, self.buffer = path, buffer

    def initialOffset(self):
        return {"byte": 0, "line": 0, "generation": 0, "sealed": 0}

    def read(self, start):
        try:
            size = os.path.getsize(self.path)
        except OSError:
            return iter(()), start
        if size < start["byte"]:
            start = {"byte": 0, "line": 0, "generation": start["generation"] + 1, "sealed": 0}
        if start["sealed"]:
            return iter(()), start
        seal = os.path.exists(f"{self.path}.sealed")  # looked up first: what is written before it is read below
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            data = f.read(STEP)
            while data and b"\n" not in data and (more := f.read(STEP)):
                data += more
            rest = f.read(1)
        whole = data[: data.rfind(b"\n") + 1]
        if seal and not rest:  # the last step takes the tail too
            whole = data
        sealed = int(seal and not rest)
        lines = whole.count(b"\n") + (sealed and not whole.endswith(b"\n") and whole != b"")
        end = {"byte": start["byte"] + len(whole), "line": start["line"] + int(lines), "generation": start["generation"], "sealed": sealed}
        return self._rows(whole, start, sealed), end

    def readBetweenOffsets(self, start, end):
        if end["generation"] != start["generation"]:
            start = {"byte": 0, "line": 0, "generation": end["generation"], "sealed": 0}
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            return self._rows(f.read(end["byte"] - start["byte"]), start, end["sealed"] and not start["sealed"])

    def _rows(self, data: bytes, start, sealed):
        name = f"{self.path}#{start['generation']}"
        parts = data.split(b"\n")
        parts = parts[:-1] if not parts[-1] else parts
        rows = [(name, start["line"] + k + 1, x.decode("utf-8", "replace"), self.buffer, False) for k, x in enumerate(parts)]
        return iter(rows + ([(name, start["line"] + len(parts) + 1, "", None, True)] if sealed else []))


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("tail").load(path), with the option `buffer` where it is known."""

    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return TailReader(self.options["path"], self.options.get("buffer"))
