"""Environment profiles and the session they describe."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Environment:
    profile: str
    master: str | None = None
    conf: dict[str, str] = field(default_factory=dict)
    seed: int = 42
    warmups: int = 1
    repeats: int = 5
    cache_state: str = "warm"


#: Settings every measuring profile shares: hints decide, nothing is reordered at run time.
SHARED = {"spark.sql.adaptive.enabled": "false", "spark.sql.cbo.enabled": "false", "spark.sql.cbo.joinReorder.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.session.timeZone": "UTC"}
PROFILES = {"local": Environment("local", "local[*]", {"spark.sql.shuffle.partitions": "8"}), "cluster": Environment("cluster", None, {"spark.sql.shuffle.partitions": "200"})}


def load_environment(path: str | None = None, profile: str | None = None) -> Environment:
    """A profile of a YAML file (shared: and profiles:), or a built-in one; COSTPLAN_PROFILE names the default."""
    name = profile or os.environ.get("COSTPLAN_PROFILE", "local")
    if path is None:
        base = PROFILES[name]
        return Environment(name, base.master, SHARED | base.conf)
    import yaml

    with open(path) as f:
        told = yaml.safe_load(f) or {}
    if name not in told.get("profiles", {}):
        raise KeyError(name)
    own, shared = told["profiles"][name] or {}, told.get("shared", {}) or {}
    as_text = lambda d: {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (d or {}).items()}
    get = lambda k, d: own.get(k, shared.get(k, d))
    return Environment(name, own.get("master"), as_text(shared.get("conf")) | as_text(own.get("conf")), int(get("seed", 42)), int(get("warmups", 1)), int(get("repeats", 5)), get("cache_state", "warm"))


def build_session(env: Environment, app: str = "costplan") -> SparkSession:
    """A session with the profile's settings; those of spark.sql.* are set again on one that runs already."""
    builder = SparkSession.builder.appName(app)
    if env.master:
        builder = builder.master(env.master)
    for k, v in env.conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in env.conf.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark
