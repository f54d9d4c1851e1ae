"""Settings in layers: defaults, a file, a file for the environment, then variables APP_SECTION__KEY."""

from __future__ import annotations

import copy
import os
import tomllib
from typing import Any

from tidemark.errors import ConfigError
from tidemark.sources.files import expand_path, resolve

DEFAULTS: dict[str, Any] = {
    "data": {"raw_dir": "data/raw", "txt_dir": "data/txt", "index_dir": "data/index", "db_dir": "data/db"},
    "chunking": {"max_tokens": 500, "overlap_percent": 0.2},
    "search": {"default_limit": 5, "max_limit": 100, "fuzzy_max_distance": 4, "fusion": "max", "metric": "l2"},
    "vector": {"dim": 1024, "num_partitions": 64, "num_sub_vectors": 16, "nprobes": 4, "refine_factor": 10},
    "text_cleaning": {"english_only": True, "lowercase": False, "min_text_length": 50, "min_line_length": 10, "max_line_length": 1000},
}
ENVIRONMENTS = ("dev", "test", "prod")


def _merge(base: dict, over: dict) -> dict:
    for k, v in over.items():
        base[k] = _merge(base.get(k, {}), v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base


def _load(path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("no library for YAML") from e
        with open(path) as f:
            return yaml.safe_load(f) or {}
    with open(path, "rb") as f:
        return tomllib.load(f)


def _value(text: str) -> Any:
    try:
        return tomllib.loads(f"x = {text}")["x"]
    except tomllib.TOMLDecodeError:
        return text


class Config:
    def __init__(self, values: dict[str, Any], env: str = "dev"):
        self.values, self.env = values, env

    @classmethod
    def load(cls, folder: str = ".", env: str | None = None, environ: dict[str, str] | None = None) -> Config:
        environ = dict(os.environ) if environ is None else environ
        env = env or environ.get("APP_ENV", "dev")
        values = copy.deepcopy(DEFAULTS)
        for name in (f"{base}{part}.{kind}" for part in ("", f".{env}") for base in ("config",) for kind in ("toml", "yaml")):
            path = os.path.join(folder, name)
            if os.path.exists(path):
                _merge(values, _load(path))
        for key, text in environ.items():
            if key.startswith("APP_") and "__" in key:
                node = values
                *parts, last = key[4:].lower().split("__")
                for p in parts:
                    node = node.setdefault(p, {})
                node[last] = _value(text)
        for key, place in (("ETL_RAW_DIR", "raw_dir"), ("ETL_TXT_DIR", "txt_dir")):
            if environ.get(key):
                values["data"][place] = environ[key]
        return cls(values, env)

    def get(self, key: str, default: Any = None) -> Any:
        """By dotted name."""
        node: Any = self.values
        for part in key.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def path(self, key: str, base: str = ".") -> str:
        value = self.get(key)
        if value is None:
            raise ConfigError(f"{key} isn't set")
        return resolve(base, expand_path(str(value)))

    def limit(self, k: int | None = None) -> int:
        """A number of results within what is allowed."""
        return max(1, min(k or self.get("search.default_limit"), self.get("search.max_limit")))

    def validate(self) -> None:
        """Raise if a value isn't allowed in this environment."""
        wrong = []
        if self.env not in ENVIRONMENTS:
            wrong.append(f"no environment {self.env!r}")
        partitions, m, probes, refine, dim = (self.get(f"vector.{k}") for k in ("num_partitions", "num_sub_vectors", "nprobes", "refine_factor", "dim"))
        wrong += [f"vector.{k} must be positive" for k in ("num_partitions", "num_sub_vectors", "nprobes", "refine_factor", "dim") if not self.get(f"vector.{k}") or self.get(f"vector.{k}") <= 0]
        if not wrong:
            if dim % m:
                wrong.append("vector.dim must be a multiple of vector.num_sub_vectors")
            if probes > partitions:
                wrong.append("vector.nprobes must not exceed vector.num_partitions")
            if self.env == "prod" and (partitions < 1024 or probes < 50 or refine < 20):
                wrong.append("prod needs at least 1024 partitions, 50 probes and a refine factor of 20")
        if not 0 <= self.get("chunking.overlap_percent") < 1:
            wrong.append("chunking.overlap_percent must be in [0, 1)")
        if wrong:
            raise ConfigError("; ".join(wrong))
