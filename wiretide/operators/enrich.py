"""Names for the numbers of a capture: containers, pods and host names from dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of


def with_containers(events: DataFrame, containers: DataFrame) -> DataFrame:
    """Adds runtime and container by cgroup; events of unknown cgroups stay."""
    return events.join(containers.select("cgroup_id", "runtime", "container"), "cgroup_id", "left")


def with_hosts(events: DataFrame, hosts: DataFrame) -> DataFrame:
    """Adds src_host and dst_host by address."""
    out = events
    for side in ("src", "dst"):
        names = hosts.select(F.col("ip").alias(f"{side}_ip"), F.col("host").alias(f"{side}_host"))
        out = out.withColumn(f"{side}_ip", host_of(F.col(side))).join(names, f"{side}_ip", "left").drop(f"{side}_ip")
    return out


def pod_names(folders: DataFrame, column: str = "name") -> DataFrame:
    """namespace, pod and uid of pod folders called ``namespace_pod_uid``."""
    pattern = r"^([^_]+)_(.*)_([^_]+)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    return folders.where(F.col(column).rlike(pattern)).select(part(1).alias("namespace"), part(2).alias("pod"), part(3).alias("uid"))


def with_pods(containers: DataFrame, pods: DataFrame) -> DataFrame:
    """Adds namespace and pod by the pod uid, which cgroups write with underscores."""
    return containers.withColumn("uid", F.translate("pod_uid", "_", "-")).join(pods, "uid", "left").drop("uid")


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of binary files, one row per content."""
    return files.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("length")).dropDuplicates(["sha256"])


def unpinned(certificates: DataFrame, pins: DataFrame) -> DataFrame:
    return certificates.join(pins, "sha256", "left_anti")
