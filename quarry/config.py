"""Settings of the retrieval engine; a missing file gives all defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    parent_chunk_size: int = 2000
    parent_chunk_overlap: int = 200
    parent_threshold: int = 2500
    child_chunk_size: int = 900
    child_chunk_overlap: int = 120
    dense_depth: int = 20
    sparse_depth: int = 20
    comparison_depth: int = 30
    rrf_constant: int = 60
    rrf_keep: int = 15
    rerank_keep: int = 5
    embedding_size: int = 64
    index_path: str = "index"


def load_config(path: str | None = None) -> Config:
    """Config from `key: value` lines; QUARRY_<KEY> in the environment wins over the file.

    A missing file gives the defaults; a file that holds no mapping is a ValueError.
    """
    config, found = Config(), {}
    if path and Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"{path} is not a mapping: {line!r}")
            found[key.strip()] = value.strip().strip("'\"")
    for f in fields(Config):
        value = os.environ.get(f"QUARRY_{f.name.upper()}", found.get(f.name))
        if value is not None:
            config = replace(config, **{f.name: type(getattr(config, f.name))(value)})
    return config
