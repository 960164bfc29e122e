"""Run configuration."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace

#: Defaults of a run.
MAX_WORDS = 200_000
MAX_FILE_SIZE = 10 * 1024 * 1024
SKIP_PATTERNS = (".git",)
SKIP_DIRS = ("node_modules", "__pycache__")

MODES = ("compat", "strict")
STATES = ("json", "parquet")


@dataclass(frozen=True)
class RunConfig:
    """What a run needs to know. Empty lists fall back to the defaults, like missing ones.

    ``mode``: ``compat`` keeps the observed behaviour in every detail, ``strict`` does what the
    options say (folders in ``skip_dirs`` are pruned, sections are printed as text, and so on).
    ``state``: ``json`` writes metadata and hashes as two JSON files, which pass through the
    driver row by row; ``parquet`` writes them as tables, for trees of any size.
    """

    repo_path: str
    output_dir: str = "output"
    max_words: int = MAX_WORDS
    max_file_size: int = MAX_FILE_SIZE
    skip_patterns: list[str] = field(default_factory=lambda: list(SKIP_PATTERNS))
    skip_dirs: list[str] = field(default_factory=lambda: list(SKIP_DIRS))
    verbose: bool = False
    mode: str = "compat"
    state: str = "json"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.state not in STATES:
            raise ValueError(f"state must be one of {STATES}")
        object.__setattr__(self, "repo_path", os.path.realpath(self.repo_path))
        object.__setattr__(self, "output_dir", os.path.realpath(self.output_dir))
        object.__setattr__(self, "skip_patterns", list(self.skip_patterns or SKIP_PATTERNS))
        object.__setattr__(self, "skip_dirs", list(self.skip_dirs or SKIP_DIRS))

    def override(self, **options) -> RunConfig:
        """With every option that is not None in place of the present one."""
        return replace(self, **{k: v for k, v in options.items() if v is not None})

    @classmethod
    def of(cls, options: dict) -> RunConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in options.items() if k in known and v is not None})


REFERENCE = re.compile(r"\$\{([^${}]+)\}")


def interpolated(options: dict) -> dict:
    """Options with ``${name}``, also dotted, and ``${oc.env:NAME}`` or ``${oc.env:NAME,default}`` filled in, wherever they stand.

    A value that is one reference takes the type of what it names. ValueError: a name that isn't
    there, or names that go round in a circle.
    """

    def named(name: str, seen: tuple[str, ...]):
        if name in seen:
            raise ValueError(f"options refer to each other in a circle: {' -> '.join((*seen, name))}")
        if name.startswith("oc.env:"):
            variable, _, default = name[7:].partition(",")
            if variable not in os.environ and "," not in name:
                raise ValueError(f"environment variable {variable} is not set")
            return os.environ.get(variable, default)
        held = options
        for part in name.split("."):
            if not isinstance(held, dict) or part not in held:
                raise ValueError(f"option {name} is not there")
            held = held[part]
        return filled(held, (*seen, name))

    def filled(value, seen: tuple[str, ...]):
        if isinstance(value, dict):
            return {k: filled(v, seen) for k, v in value.items()}
        if isinstance(value, list):
            return [filled(v, seen) for v in value]
        if not isinstance(value, str):
            return value
        if whole := REFERENCE.fullmatch(value):
            return named(whole[1], seen)
        return REFERENCE.sub(lambda m: str(named(m[1], seen)), value)

    return filled(options, ())


def load_yaml_config(path: str) -> dict:
    """A YAML file as a mapping: FileNotFoundError if it isn't there, ValueError if it can't be parsed."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(f"Configuration file not found: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            held = yaml.safe_load(f)
    except yaml.YAMLError as e:
        raise ValueError(f"Error parsing YAML file: {e}") from e
    if held is not None and not isinstance(held, dict):
        raise ValueError("Error parsing YAML file: no mapping")
    return held or {}


def validate_directory(path: str) -> None:
    """Create a folder with its parents unless it is there."""
    os.makedirs(path, exist_ok=True)
