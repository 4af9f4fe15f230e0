"""Runs kept as Parquet tables: parameters, tags, metrics, refined inputs, outputs with lineage.

The small tables are partitioned by ``run_id``; reading one run touches that run's files only. A saved pipeline lies in
folders of its own, named by a *manifest* that is written last: with all schemas, the places of its tables, and what its
joins really joined. Without a manifest there is no pipeline, so one that was half written is never seen, and saving it
again starts in new folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import LINEAGE, canonical
from ..operators.tracked import JoinRecord
from .classification import ClassificationPipeline
from .fact_table import joined_sources
from .profile import pipeline_profile

_SCHEMAS = {
    "params": "key string, value string",
    "tags": "key string, value string",
    "metrics": "key string, value double",
    "manifests": "version int, saved_at timestamp, manifest string",
}
#: Of the manifest's form; a store refuses those it does not know.
VERSION = 2


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def start(self, series: str, params: Mapping | None = None) -> Run:
        """Open a new run of a series and note the parameters of its pipeline."""
        run = Run(self, uuid.uuid4().hex)
        run.set_tags({"series": series})
        if params:
            run.log_params({f"argument.{k}": v for k, v in params.items()})
        return run

    def run(self, run_id: str) -> Run:
        return Run(self, run_id)

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        """``params``, ``tags``, ``metrics`` or ``manifests``, of all runs or of one."""
        schema = f"{_SCHEMAS[name]}, run_id string"
        try:
            df = self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], schema)  # nothing was written yet
        return df if run_id is None else df.filter(F.col("run_id") == run_id)

    def saved_runs(self, series: str | None = None) -> DataFrame:
        """``(run_id, series, saved_at)`` of the runs whose pipeline is complete."""
        named = self.table("tags").filter(F.col("key") == "series").select("run_id", F.col("value").alias("series"))
        saved = self.table("manifests").groupBy("run_id").agg(F.max("saved_at").alias("saved_at"))
        found = saved.join(named, "run_id")
        return found if series is None else found.filter(F.col("series") == series)

    def features(self, run_id: str, split: str) -> DataFrame:
        """Lineage and features of one split of a stored run."""
        outputs = self._read(self._manifest(run_id)["outputs"])
        return outputs.filter(F.col("split") == split).select(LINEAGE, "features")

    def load(self, run_id: str) -> ClassificationPipeline:
        """Rebuild the stored pipeline. Sources whose files are gone are left out."""
        manifest = self._manifest(run_id)
        outputs = self._read(manifest["outputs"]).withColumn(LINEAGE, canonical(F.col(LINEAGE)))
        rows: dict[str, dict[int, DataFrame]] = {"train": {}, "test": {}}
        for split, source_id, table in manifest["sources"]:
            stored = self._read_if_there(table)
            if stored is not None:
                rows[split][source_id] = stored.withColumn(LINEAGE, canonical(F.col(LINEAGE)))
        joins = frozenset(
            JoinRecord(j["number"], frozenset(j["sources"]), None, frozenset(j["seen"])) for j in manifest["joins"]
        )
        return ClassificationPipeline(
            outputs,
            rows,
            {int(k): v for k, v in manifest["names"].items()},
            joins,
            known_facts=manifest["facts"],
            preprocessing=[(kind, arguments) for kind, arguments in manifest["preprocessing"]],
        )

    def _manifest(self, run_id: str) -> dict:
        """The last manifest of the run."""
        last = self.table("manifests", run_id).orderBy(F.col("saved_at").desc()).first()
        if last is None:
            raise ValueError(f"run {run_id!r} holds no pipeline")
        if last["version"] != VERSION:
            raise ValueError(f"run {run_id!r} has a manifest of version {last['version']}, not {VERSION}")
        return json.loads(last["manifest"])

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, table: dict) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table['place']}")

    def _read_if_there(self, table: dict) -> DataFrame | None:
        try:
            return self._read(table)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise


class Run:
    def __init__(self, store: RunStore, run_id: str):
        self.store = store
        self.run_id = run_id

    def log_params(self, values: Mapping) -> None:
        self._append("params", [(k, str(v)) for k, v in values.items()])

    def set_tags(self, values: Mapping) -> None:
        self._append("tags", [(k, str(v)) for k, v in values.items()])

    def log_metrics(self, values: Mapping) -> None:
        self._append("metrics", [(k, None if v is None else float(v)) for k, v in values.items()])

    def _append(self, table: str, rows: list[tuple]) -> None:
        (
            self.store.spark.createDataFrame(rows, _SCHEMAS[table])
            .withColumn("run_id", F.lit(self.run_id))
            .coalesce(1)
            .write.mode("append")
            .partitionBy("run_id")
            .parquet(self.store._path(table))
        )

    def table_path(self, name: str) -> str:
        return f"{self.store.root}/artifacts/{self.run_id}/{name}"

    def write_table(self, df: DataFrame, name: str) -> str:
        path = self.table_path(name)
        df.write.parquet(path)
        return path

    def read_table(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(self.table_path(name))

    def save(self, pipeline: ClassificationPipeline) -> None:
        """Write the pipeline's outputs and sources, each row with its lineage, its profile, and last the manifest."""
        attempt = f"artifacts/{self.run_id}/pipeline-{uuid.uuid4().hex}"

        def stored(df: DataFrame, name: str, *by: str) -> dict:
            df.write.partitionBy(*by).parquet(f"{self.store.root}/{attempt}/{name}")
            return {"place": f"{attempt}/{name}", "schema": df.schema.jsonValue()}

        outputs = stored(pipeline.outputs, "outputs", "split")
        tables: dict[int, dict] = {}
        sources = []
        for split, by_id in pipeline.source_rows.items():
            for source_id, rows in by_id.items():
                shared = pipeline.source_rows["train"].get(source_id) is rows
                if split == "train" or not shared:
                    tables[source_id] = stored(rows, f"source-{split}-{source_id}")
                sources.append((split, source_id, tables[source_id]))
        manifest = {
            "outputs": outputs,
            "sources": sources,
            "names": pipeline.source_names,
            "joins": [
                {"number": j.number, "sources": sorted(j.source_ids), "seen": sorted(joined_sources(j))}
                for j in sorted(pipeline.joins, key=lambda j: j.number)
            ],
            "facts": {s: pipeline.fact_id(s) for s in pipeline.source_rows},
            "preprocessing": pipeline.preprocessing,
        }
        self.log_params(dict(pipeline_profile(pipeline)))
        rows = [(VERSION, datetime.now(timezone.utc), json.dumps(manifest))]
        self._append("manifests", rows)
