"""Connectors: what a registration names, as tables of probes, contents and normalised texts."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import short_hash
from quillmere.sources import readers
from quillmere.sources.transcripts import sessions_text

#: Kinds of connectors and of artifacts, and redaction policies.
ARTIFACTS = ("file", "transcript", "code", "document", "attachment")
SECRETS, PERSONAL, NONE = "secrets", "secrets-and-pii", "not-applied"


def _probe(rows: DataFrame, source_id: Column, opaque: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(source_id.alias("source_id"), "external_key", "path_hash", none.alias("commit_sha"), none.alias("revision"), none.alias("etag"), (none if opaque is None else opaque).alias("opaque_version"), "updated_at", "bytes")


class Connector(ABC):
    """Read-only access to one place that knowledge comes from.

    probes(): every source that is there with its version, contents not read. contents(): the
    bytes of wanted sources, each with what went wrong instead. normalised(): texts of contents.
    A source that fails is a row with an error; the others go on. `complete`: probes list all
    that is there, so what they do not list is gone.
    """

    connector_id: str
    complete: bool = True
    #: The redaction that texts of this connector need whatever the caller asks for.
    least_redaction: str = SECRETS
    content_type: str = "text/plain"
    project_keys: tuple[str, ...] = ()

    @abstractmethod
    def scope(self) -> dict:
        """What decides which sources are in reach; another scope is another generation of the connector."""

    @abstractmethod
    def probes(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def contents(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """(source_id, external_key, content, error) of the `wanted` (source_id)."""

    def normalised(self, contents: DataFrame) -> DataFrame:
        """(source_id, external_key, content, text, error): text is null and error set where bytes are no UTF-8."""
        valid = F.is_valid_utf8(F.col("content").cast("string"))
        error = F.coalesce("error", F.when(F.col("content").isNull(), "no content").when(~valid, "not valid UTF-8"))
        return contents.select("source_id", "external_key", "content", F.when(error.isNull(), F.col("content").cast("string")).alias("text"), error.alias("error"))

    def scope_fingerprint(self, spark: SparkSession) -> str:
        return spark.range(1).select(F.sha2(F.lit(json.dumps({"kind": type(self).__name__, **self.scope()}, sort_keys=True)), 256)).first()[0]


@dataclass
class Files(Connector):
    """Files below a folder whose keys match a pattern."""

    connector_id: str
    base_dir: str
    patterns: tuple[str, ...] = ("**/*",)
    artifact: str = "file"
    project_keys: tuple[str, ...] = ()
    content_type: str = "text/plain"

    def scope(self) -> dict:
        return {"base_dir": self.base_dir, "patterns": sorted(self.patterns), "artifact": self.artifact, "project_keys": sorted(self.project_keys)}

    def _load(self, spark: SparkSession, content: bool) -> DataFrame:
        readers.register(spark)
        rows = spark.read.format("quillmere-files").options(path=self.base_dir, include="\n".join(self.patterns), content=str(content).lower()).load()
        return rows.withColumn("source_id", short_hash("src_", 24, F.lit(self.connector_id), F.col("external_key")))

    def probes(self, spark: SparkSession) -> DataFrame:
        return _probe(self._load(spark, False), F.col("source_id"), F.concat_ws(":", F.col("bytes").cast("string"), "updated_at"))

    def contents(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        return self._load(spark, True).join(wanted.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "external_key", "content", "error")


@dataclass
class Transcripts(Files):
    """JSON-lines sessions of agents; secrets and personal data are always taken out."""

    patterns: tuple[str, ...] = ("**/*.jsonl",)
    artifact: str = "transcript"
    content_type: str = "application/x-ndjson"
    least_redaction = PERSONAL

    def normalised(self, contents: DataFrame) -> DataFrame:
        """Texts are the sessions of a file, rebuilt from their records."""
        plain = super().normalised(contents)
        texts = sessions_text(plain.where("error is null").select("source_id", "text"))
        return plain.drop("text").join(texts, "source_id", "left").withColumn("text", F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))).select("source_id", "external_key", "content", "text", "error")


@dataclass
class GitTree(Connector):
    """Files of a git tree at a ref; a blob's hash is its version."""

    connector_id: str
    repository_dir: str
    ref: str = "HEAD"
    pathspecs: tuple[str, ...] = ()
    project_key: str = ""

    def scope(self) -> dict:
        return {"repository_dir": self.repository_dir, "ref": self.ref, "pathspecs": sorted(self.pathspecs), "project_key": self.project_key}

    def _load(self, spark: SparkSession, content: bool) -> DataFrame:
        readers.register(spark)
        rows = spark.read.format("quillmere-git").options(path=self.repository_dir, ref=self.ref, include="\n".join(self.pathspecs), content=str(content).lower()).load()
        return rows.withColumn("source_id", short_hash("src_", 24, F.lit(self.connector_id), F.lit(self.project_key), F.col("external_key")))

    def probes(self, spark: SparkSession) -> DataFrame:
        return _probe(self._load(spark, False), F.col("source_id"))

    def contents(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        return self._load(spark, True).join(wanted.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "external_key", "content", "error")


@dataclass
class Table(Connector):
    """Rows of a table (external_key, content, updated_at) as sources; for texts that Spark holds already."""

    connector_id: str
    rows: DataFrame
    complete: bool = True

    def scope(self) -> dict:
        return {"columns": sorted(self.rows.columns)}

    def _keyed(self) -> DataFrame:
        return self.rows.withColumn("source_id", short_hash("src_", 24, F.lit(self.connector_id), F.col("external_key")))

    def probes(self, spark: SparkSession) -> DataFrame:
        body = F.col("content").cast("binary")
        rows = self._keyed().select("source_id", "external_key", F.sha2(body, 256).alias("path_hash"), F.col("updated_at").cast("string").alias("updated_at"), F.octet_length(body).cast("long").alias("bytes"))
        return _probe(rows, F.col("source_id"))

    def contents(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        rows = self._keyed().select("source_id", "external_key", F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
        return rows.join(wanted.select("source_id").distinct(), "source_id", "left_semi")


#: Options of each kind: those that must be given, and all.
_OPTIONS = {
    "files": (Files, {"base_dir"}, {"base_dir", "patterns", "artifact", "project_keys", "content_type"}),
    "transcripts": (Transcripts, {"base_dir"}, {"base_dir", "patterns", "project_keys"}),
    "git": (GitTree, {"repository_dir"}, {"repository_dir", "ref", "pathspecs", "project_key"}),
}


def from_registration(registration: dict) -> Connector:
    """The connector of a registration {connector_id, kind, options}; what it doesn't know is an error.

    Nothing is read: a connector is made, and its folder may be missing until it is probed.
    """
    unknown = set(registration) - {"connector_id", "kind", "options"}
    if unknown or not {"connector_id", "kind"} <= set(registration):
        raise ValueError(f"a registration has connector_id, kind and options, not {sorted(registration)}")
    name, kind, options = registration["connector_id"], registration["kind"], dict(registration.get("options") or {})
    if not isinstance(name, str) or not name or not all(c.isalnum() or c in "_.-" for c in name):
        raise ValueError(f"no name of a connector: {name!r}")
    if kind not in _OPTIONS:
        raise ValueError(f"no kind of connector: {kind!r}; known are {', '.join(sorted(_OPTIONS))}")
    make, needed, known = _OPTIONS[kind]
    if missing := needed - set(options):
        raise ValueError(f"{kind} needs {', '.join(sorted(missing))}")
    if odd := set(options) - known:
        raise ValueError(f"{kind} has no option {', '.join(sorted(odd))}")
    for key in ("patterns", "pathspecs", "project_keys"):
        if key in options:
            if isinstance(options[key], str) or any("\n" in p for p in options[key]):
                raise ValueError(f"{key} is a list of single lines")
            options[key] = tuple(options[key])
    if options.get("artifact", "file") not in ARTIFACTS:
        raise ValueError(f"no artifact: {options['artifact']!r}")
    return make(connector_id=name, **options)


__all__ = ["ARTIFACTS", "NONE", "PERSONAL", "SECRETS", "Connector", "Files", "GitTree", "Table", "Transcripts", "from_registration"]
