"""Where an engine keeps its things and which model it asks, from arguments and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .sources.files import Catalog, catalog


@dataclass(frozen=True)
class Config:
    """``storage_mode`` is local or gcs; the model's key is read from the environment variable ``key_variable`` when it is needed and kept nowhere."""

    storage_mode: str = "local"
    storage_path: str = "data"
    bucket: str = ""
    model: str = ""
    key_variable: str = "LLM_API_KEY"
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **own) -> Config:
        """Arguments first, then STORAGE_MODE, STORAGE_PATH, GCS_BUCKET, LLM_MODEL and LOG_LEVEL, then the defaults; a bucket without a mode means gcs. Unknown names and modes raise ValueError."""
        env = os.environ if env is None else env
        if unknown := set(own) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        names = {"storage_mode": "STORAGE_MODE", "storage_path": "STORAGE_PATH", "bucket": "GCS_BUCKET", "model": "LLM_MODEL", "log_level": "LOG_LEVEL"}
        given = {k: env[v] for k, v in names.items() if env.get(v)}
        if "bucket" in given and "storage_mode" not in given:
            given["storage_mode"] = "gcs"
        found = cls(**(given | own))
        if found.storage_mode.lower() not in ("local", "gcs"):
            raise ValueError(f"unknown storage mode: {found.storage_mode}")
        return cls(**{f.name: getattr(found, f.name).lower() if f.name == "storage_mode" else getattr(found, f.name) for f in fields(cls)})

    def validate(self, env: Mapping[str, str] | None = None) -> None:
        """Raises ValueError where a key, a bucket or a path is missing. Nothing calls this by itself."""
        env = os.environ if env is None else env
        if not env.get(self.key_variable, "").strip():
            raise ValueError(f"{self.key_variable} is not set")
        if not (self.bucket if self.storage_mode == "gcs" else self.storage_path):
            raise ValueError("no bucket named" if self.storage_mode == "gcs" else "no path named")

    def catalog(self, spark: SparkSession) -> Catalog:
        return catalog(spark, self.storage_mode, self.bucket if self.storage_mode == "gcs" else self.storage_path, {})
