"""Settings of a crawl and index, read from JSON and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass
class Config:
    """``worker_count`` from 50 to 2000 and ``max_typo`` from 1 to 4; 1 to 500 base URLs; the paths must be given."""

    base_urls: list[str] = field(default_factory=list)
    cache_path: str = ""
    filter_url: str = ""
    index_path: str = ""
    worker_count: int = 50
    max_typo: int = 3
    only_same_domain: bool = False

    def validate(self) -> Config:
        wrong = []
        if not 1 <= len(self.base_urls) <= 500:
            wrong.append("base_urls: 1 to 500 are required")
        wrong += [f"{name}: required" for name in ("cache_path", "filter_url", "index_path") if not getattr(self, name)]
        if not 50 <= self.worker_count <= 2000:
            wrong.append("worker_count: 50 to 2000")
        if not 1 <= self.max_typo <= 4:
            wrong.append("max_typo: 1 to 4")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    @classmethod
    def load(cls, path: str) -> Config:
        """Values of a JSON file as they are; unknown names are ignored. Checking is a step of its own."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        return cls(**{x.name: given[x.name] for x in fields(cls) if x.name in given})
