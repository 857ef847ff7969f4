"""Runs that write several outputs and publish them together.

Each run writes below a folder of its own. Its manifest, one row per output, is published as the
next version when all outputs are whole, so readers see the earlier set until then and the new
one after it, never a mix. A run that dies leaves a folder that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from prioscope.sources.staging import delete_folder, folders_in, newest_version, publish_version, versions_of


def run_once(spark: SparkSession, base: str, build, run_id: str | None = None):
    """Call ``build(folder)``, then publish what it wrote. Returns what ``build`` returned.

    A run repeated under its own id starts afresh, unless it was published: then it is refused.
    """
    run_id = run_id or uuid.uuid4().hex
    folder = f"{base}/runs/{run_id}"
    if run_id in published_runs(spark, base):
        raise ValueError(f"run {run_id} is published; give a rerun an id of its own")
    delete_folder(spark, folder)
    made = build(folder)
    names = folders_in(spark, folder)
    if not names:
        raise ValueError("the run wrote nothing, so there is nothing to publish")
    publish_version(
        spark.createDataFrame([(run_id, n, f"{folder}/{n}") for n in names], "run_id STRING, name STRING, path STRING").coalesce(1),
        f"{base}/manifest",
    )
    return made


def published_runs(spark: SparkSession, base: str) -> list[str]:
    """Ids of all published runs, the oldest first."""
    ids = []
    for number in versions_of(spark, f"{base}/manifest"):
        ids += [r.run_id for r in spark.read.parquet(f"{base}/manifest/version-{number}").select("run_id").distinct().collect()]
    return ids


def outputs(spark: SparkSession, base: str) -> dict[str, str]:
    """Path of each output of the newest published run."""
    return {r["name"]: r["path"] for r in newest_version(spark, f"{base}/manifest")[1].collect()}


def remove_unpublished(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Delete the folders of runs that died, and of published ones but for the newest ``keep``.

    Call it when no run is being written and nothing reads the older ones.
    """
    staying = published_runs(spark, base)[-keep:] if keep else []
    gone = [name for name in folders_in(spark, f"{base}/runs") if name not in staying]
    for name in gone:
        delete_folder(spark, f"{base}/runs/{name}")
    return gone
