"""Runs as a data source: folders <root>/<group>/<run> with a log (a JSON array or lines, in one file or several) and tags.json.

    register(spark)
    spark.read.format("turnloom_runs").option("path", "logs:2024").option("roots", '{"logs": "s3://bucket/logs"}').load()

A path is a URI or ``name:rest`` with one of the named ``roots``. Runs are read if they have one of ``tags_in`` (any if none is
given) and none of ``tags_not_in``. A filter on grp or run, where Spark hands it over, leaves whole runs out; each run is a
partition. A run without a log is an error that names it, or left out with the option missing=skip.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..shared import written

SCHEMA = "grp string, run string, tags array<string>, ID string, turn_id int, pred map<string,string>, completion string"
LOG = "log"


def resolved(path: str, roots: dict[str, str]) -> str:
    """``name:rest`` below the root of that name; other paths and URIs as they are. An unknown name is an error."""
    name, colon, rest = path.partition(":")
    if not colon or rest.startswith("/"):
        return path
    if name not in roots:
        raise ValueError(f"no root is named {name!r}: {sorted(roots)}")
    return f"{roots[name].rstrip('/')}/{rest}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class _Run(InputPartition):
    grp: str
    run: str
    tags: list[str]
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        roots = json.loads(options.get("roots", "{}"))
        if "path" not in options:
            raise ValueError("the option path names the folder of the groups")
        self.uri = resolved(options["path"], roots)
        names = lambda key: {x for x in options.get(key, "").split(",") if x}
        self.wanted, self.unwanted = names("tags_in"), names("tags_not_in")
        self.skip = options.get("missing", "error") == "skip"
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("grp",), ("run",)):
                key = f.attribute[0]
                self.only[key] = self.only.get(key, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.uri)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder of runs: {self.uri}")
        out: list[InputPartition] = []
        folders = lambda at: sorted((x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.Directory), key=lambda x: x.base_name)
        for grp in folders(root):
            if grp.base_name not in self.only.get("grp", {grp.base_name}):
                continue
            for run in folders(grp.path):
                if run.base_name not in self.only.get("run", {run.base_name}):
                    continue
                tags = self._tags(fs, run.path)
                if self.wanted and not self.wanted & set(tags) or self.unwanted & set(tags):
                    continue
                at = f"{run.path}/{LOG}"
                there = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
                files = sorted(x.path for x in there if x.type == pafs.FileType.File and x.extension == "json" and not x.base_name.startswith(("_", ".")))
                if not files and not self.skip:
                    raise FileNotFoundError(f"run {grp.base_name}/{run.base_name} has no log: {at}")
                if files:
                    out.append(_Run(grp.base_name, run.base_name, tags, files))
        return out

    @staticmethod
    def _tags(fs: pafs.FileSystem, run: str) -> list[str]:
        at = f"{run}/tags.json"
        if fs.get_file_info(at).type != pafs.FileType.File:
            return []
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = filesystem(self.uri)
        for at in partition.files:
            with fs.open_input_stream(at) as f:
                for t in _turns(f.read().decode()):
                    yield partition.grp, partition.run, partition.tags, t.get("ID"), t.get("turn_id"), t.get("pred"), t.get("completion")


def _turns(text: str) -> list[dict]:
    """A JSON array, or a JSON object a line."""
    if text.lstrip().startswith("["):
        return json.loads(text)
    return [json.loads(line) for line in text.splitlines() if line.strip()]


class RunsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "turnloom_runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and have Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunsSource)


def read_runs(spark: SparkSession, path: str, tags_in: Iterable[str] = (), tags_not_in: Iterable[str] = (), roots: dict[str, str] | None = None, missing: str = "error") -> DataFrame:
    register(spark)
    r = spark.read.format("turnloom_runs").option("path", path).option("roots", json.dumps(roots or {})).option("missing", missing)
    return r.option("tags_in", ",".join(tags_in)).option("tags_not_in", ",".join(tags_not_in)).load()


def _put(uri: str, text: str) -> None:
    """A file that is there is whole: it is written beside and moved."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{path}.part") as f:
        f.write(text.encode())
    fs.move(f"{path}.part", path)


def _there(uri: str) -> bool:
    fs, path = filesystem(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def write_run(log: DataFrame, targets: list[str], group: str, run: str, batch: str, tags: Iterable[str] = ()) -> list[str]:
    """Add a batch of a run's log (ID, turn_id, pred, completion) to every target, the root folders of runs; return the targets
    that it was added to now.

    A batch goes to a folder of its own, whose files are moved into the log when all are whole, and a mark beside says that
    they are there. So a batch that is written again adds nothing, and after a failure between two targets the next call brings the
    one that lacks it. With ``foreachBatch`` the batch is the stream's number.
    """
    todo = [t for t in targets if not _there(f"{t}/{group}/{run}/done/{batch}")]
    if not todo:
        return []
    rows = written(log.select("ID", "turn_id", "pred", "completion"), "batch")  # the same rows for all targets
    for target in todo:
        at = f"{target}/{group}/{run}"
        rows.write.mode("overwrite").json(f"{at}/pending/{batch}")
        fs, pending = filesystem(f"{at}/pending/{batch}")
        _, into = filesystem(f"{at}/{LOG}")
        fs.create_dir(into, recursive=True)
        for x in fs.get_file_info(pafs.FileSelector(into)):
            if x.base_name.startswith(f"{batch}-"):  # of a call that ended before its mark
                fs.delete_file(x.path)
        parts = [x.path for x in fs.get_file_info(pafs.FileSelector(pending)) if x.extension == "json" and not x.base_name.startswith(("_", "."))]
        for i, x in enumerate(sorted(parts)):
            fs.move(x, f"{into}/{batch}-{i:05d}.json")
        if tags:
            _put(f"{at}/tags.json", json.dumps(sorted(tags)))
        _put(f"{at}/done/{batch}", "")
    return todo


def stream_runs(stream: DataFrame, targets: list[str], group: str, run: str, tags: Iterable[str] = (), **options: str):
    """A streaming query that adds each of its batches to all targets, once."""
    add = lambda df, n: write_run(df, targets, group, run, f"{n:09d}", tags)
    return stream.writeStream.foreachBatch(add).options(**options)
