"""Settings of a scan: a document found by name, checked, over defaults, under environment variables."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

#: File names looked for, in order.
NAMES = [".quillscan.yml", ".quillscan.yaml", "quillscan.yml", "quillscan.yaml", "quillscan.json"]
FORMATS = ["text", "json", "json-report", "sarif", "github"]


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: ["node_modules", "dist", "build", ".git"])
    preset: str = "all"
    custom: str | None = None
    disable: list[str] = field(default_factory=list)
    directive: str = "scan-ignore"
    output: str = "text"
    lanes: int = 5
    max_cost: float | None = None
    model: str | None = None
    cache: str | None = None
    cache_ttl: int = 86_400
    review: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.preset not in ("all", "owasp-top-10", "none"):
            raise ConfigError(f"unknown preset {self.preset!r}")
        if self.output not in FORMATS:
            raise ConfigError(f"unknown output {self.output!r}")
        if isinstance(self.review, str):
            self.review = self.review.split()
        if not 1 <= self.lanes <= 20:
            raise ConfigError("lanes must be within 1 and 20")


def load(folder: str = ".", path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The settings of `path`, else of the first known name in folder, else defaults; environment variables win."""
    env = os.environ if env is None else env
    found = Path(path) if path else next((p for n in NAMES if (p := Path(folder, n)).exists()), None)
    if path and not found.exists():
        raise ConfigError(f"{path}: not found")
    doc = {}
    if found:
        try:
            if found.suffix == ".json":
                doc = json.loads(found.read_text())
            else:
                import yaml

                doc = yaml.safe_load(found.read_text()) or {}
        except ValueError as e:
            raise ConfigError(f"{found}: {e}") from e
        if not isinstance(doc, dict) or (odd := sorted(set(doc) - {f.name for f in fields(Config)})):
            raise ConfigError(f"{found}: unknown keys {odd if isinstance(doc, dict) else ''}")
    for key, name, kind in (("model", "QUILLSCAN_MODEL", str), ("max_cost", "QUILLSCAN_MAX_COST", float)):
        if env.get(name):
            doc[key] = kind(env[name])
    return Config(**doc)


SCAFFOLD = "preset: all\ndirective: scan-ignore\noutput: text\nlanes: 5\n"
RULE_SCAFFOLD = "id: X-001\nname: My rule\nseverity: medium\ncategory: injection\nlanguages: [python]\ndescription: What it finds\npatterns:\n  - function: {match: [run]}\n    arguments: [{type: string_concat}]\n"


def scaffold(path: str, text: str = SCAFFOLD, force: bool = False) -> None:
    target = Path(path)
    if target.exists() and not force:
        raise ConfigError(f"{path}: exists")
    target.write_text(text)
