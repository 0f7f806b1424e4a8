"""The label log as a stream for subscribers (U3, ST6): a Python data source whose offset is the last id given out.

    spark.dataSource.register(label_replay())
    spark.readStream.format("label_replay").options(log=…, marks=…, environment="production", cursor="42").load()

A subscriber starts behind its cursor: the first batch is the snapshot, later ones are what has been added, and the checkpoint keeps the id reached, so
that each label comes once across restarts. What may be given out is bounded by the high-water marks, which the label stream writes after
the log of a batch, and by open reservations of padding (``streaming/padding.py``): an id becomes visible only when all ids before it are.

A micro-batch reads the files that hold its ids, one task each: of the batches whose marks lie behind the offset, found by bisection, the
blocks between the two offsets; inside a file the ids are a filter on its row groups. Neither the age nor the length of the log matters.

The same name reads the snapshot as a table (``spark.read.format("label_replay")``). The files are opened by pyarrow: local and shared folders, and
the remote file systems that pyarrow was built with.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource

SCHEMA = "environment string, id bigint, src string, uri string, cid string, val string, neg boolean, cts timestamp, exp timestamp, sig binary"


def label_replay() -> type[DataSource]:
    """The data source ``label_replay``. Its classes are made here, so that they go to the Python workers as a whole."""
    import hashlib
    import posixpath
    from urllib.parse import unquote

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.datasource import DataSourceReader, DataSourceStreamReader, InputPartition

    schema_text = SCHEMA
    kinds = {"environment": pa.string(), "id": pa.int64(), "neg": pa.bool_(), "cts": pa.timestamp("us", "UTC"), "exp": pa.timestamp("us", "UTC"), "sig": pa.binary()}

    class Files(InputPartition):
        def __init__(self, path: str, after: int, upto: int):
            self.path, self.after, self.upto = path, after, upto

    class Log:
        """Folders of a stored log and what its marks say."""

        def __init__(self, options):  # noqa: ANN001
            self.log, self.marks, self.environment = options["log"].rstrip("/"), options["marks"].rstrip("/"), options["environment"]
            self.block_ids = int(options.get("block_ids", 1_000_000))
            self.cursor = int(options.get("cursor", 0))

        def open(self, path: str):  # noqa: ANN202
            return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

        def names(self, path: str) -> list[str]:
            system, place = self.open(path)
            found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
            return sorted(posixpath.basename(f.path) for f in found)

        def rows(self, folder: str) -> list[dict]:
            system, _ = self.open(folder)
            return [r for n in self.names(folder) if n.endswith(".parquet") for r in pq.ParquetFile(system.open_input_file(self.open(f"{folder}/{n}")[1])).read().to_pylist()]

        def batches(self) -> list[int]:
            """Numbers of the batches whose marks are whole, the newest first."""
            numbers = sorted((int(n.split("=")[1]) for n in self.names(self.marks) if n.startswith("batch_id=")), reverse=True)
            return numbers

        def mark(self, batch: int) -> int | None:
            """The last id of the environment after this batch (0: none yet), or nothing if its mark isn't whole."""
            folder = f"{self.marks}/batch_id={batch}"
            if "_SUCCESS" not in self.names(folder):
                return None
            return max((r["max_id"] for r in self.rows(folder) if r["environment"] == self.environment), default=0)

        def pads(self) -> list[tuple[int, int, bool]]:
            """(from_id, max_id, closed) of the environment's padding."""
            key = hashlib.sha256(self.environment.encode()).hexdigest()[:16]
            closed, out = set(self.names(f"{self.marks}_pads_closed")), []
            for cursor in self.names(f"{self.marks}_pads"):
                for row in self.rows(f"{self.marks}_pads/{cursor}/environment_key={key}") if cursor.startswith("cursor=") else []:
                    out.append((row.get("from_id"), row["max_id"], f"{key}-{row['max_id']}" in closed))
            return out

        def horizon(self) -> int:
            """The last id that is visible."""
            last = next((m for m in map(self.mark, self.batches()) if m is not None), 0)
            pads = self.pads()
            last = max([last, *(to for _, to, closed in pads if closed)])
            return min([last, *(since for since, _, closed in pads if not closed and since is not None)])

        def files(self, after: int, upto: int) -> list[Files]:
            """The files that may hold ids behind ``after`` up to ``upto``."""
            numbers = self.batches()[::-1]
            while numbers and self.mark(numbers[-1]) is None:
                numbers.pop()
            # marks only grow: the first batch behind the offset by bisection
            low, high = 0, len(numbers)
            while low < high:
                middle = (low + high) // 2
                if (self.mark(numbers[middle]) or 0) > after:
                    high = middle
                else:
                    low = middle + 1
            folders = numbers[low:]
            folders += [-to for since, to, closed in self.pads() if closed and to > after]
            out = []
            for batch in folders:
                top = f"{self.log}/batch_id={batch}"
                for part in self.names(top):
                    if part.startswith("environment=") and unquote(part.split("=", 1)[1]) == self.environment:
                        for name in self.names(f"{top}/{part}"):
                            if name.startswith("block=") and after // self.block_ids <= int(name.split("=")[1]) <= upto // self.block_ids:
                                out += [Files(f"{top}/{part}/{name}/{f}", after, upto) for f in self.names(f"{top}/{part}/{name}") if f.endswith(".parquet")]
            return out

        def read(self, part: Files):  # noqa: ANN202
            system, place = self.open(part.path)
            table = pq.read_table(place, filesystem=system, filters=(pc.field("id") > part.after) & (pc.field("id") <= part.upto), partitioning=None)
            columns = []
            for name in (f.strip().split(" ")[0] for f in schema_text.split(",")):
                if name == "environment":
                    columns.append(pa.array([self.environment] * len(table), pa.string()))
                    continue
                kind, column = kinds.get(name, pa.string()), table.column(name)
                if pa.types.is_timestamp(kind) and column.type.tz is None:
                    column = column.cast(pa.timestamp("us")).cast(kind)
                columns.append(column.cast(kind))
            yield from pa.table(columns, names=[f.strip().split(" ")[0] for f in schema_text.split(",")]).to_batches()

    class Snapshot(Log, DataSourceReader):
        def partitions(self):  # noqa: ANN202
            return self.files(self.cursor, self.horizon()) or [Files("", 0, 0)]

        def read(self, part):  # noqa: ANN001, ANN202
            return Log.read(self, part) if part.path else iter(())

    class Changes(Log, DataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {"environment": self.environment, "id": self.cursor}

        def latestOffset(self, start=None, limit=None) -> dict:  # noqa: ANN001, N802
            return {"environment": self.environment, "id": max(self.horizon(), self.cursor)}

        def partitions(self, start: dict, end: dict):  # noqa: ANN202
            return self.files(start["id"], end["id"]) if end["id"] > start["id"] else []

        def read(self, part):  # noqa: ANN001, ANN202
            return Log.read(self, part)

        def commit(self, end: dict) -> None:
            pass

        def stop(self) -> None:
            pass

    class LabelReplay(DataSource):
        @classmethod
        def name(cls) -> str:
            return "label_replay"

        def schema(self) -> str:
            return schema_text

        def reader(self, schema):  # noqa: ANN001, ANN202
            return Snapshot(self.options)

        def streamReader(self, schema):  # noqa: ANN001, ANN202, N802
            return Changes(self.options)

    return LabelReplay
