"""Command line: ``python -m grainmill --repo-path TREE --output-dir OUT``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from .config import STATES, RunConfig, interpolated

log = logging.getLogger("grainmill.cli")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grainmill", description="Turn a tree of files into text chunks.")
    p.add_argument("--config-file", default="config.yaml")
    p.add_argument("--repo-path")
    p.add_argument("--output-dir")
    p.add_argument("--max-words", type=int)
    p.add_argument("--max-file-size", type=int)
    p.add_argument("--skip-patterns", action="append")
    p.add_argument("--skip-dirs", action="append")
    p.add_argument("--verbose", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--mode", choices=("compat", "strict"))
    p.add_argument("--state", choices=STATES)
    return p


def options(argv: list[str] | None = None) -> dict:
    """The file's options with those of the command line over them; ValueError says what is wrong."""
    args = vars(parser().parse_args(argv))
    path = args.pop("config_file")
    held: dict = {}
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            held = interpolated(yaml.safe_load(f) or {})
    elif not args["repo_path"]:
        raise ValueError(f"no configuration file {path} and no --repo-path")
    held |= {k: v for k, v in args.items() if v is not None}
    repo = held.get("repo_path")
    if not repo:
        raise ValueError("repo_path is missing")
    if not os.path.exists(repo):
        raise ValueError(f"{repo} doesn't exist")
    if not os.path.isdir(repo):
        raise ValueError(f"{repo} is no folder")
    return held


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    try:
        config = RunConfig.of(options(argv))
        if config.verbose:
            log.setLevel(logging.DEBUG)
            log.debug("options: %s", config)
        from pyspark.sql import SparkSession

        from .plans.pipeline import Pipeline

        Pipeline(SparkSession.builder.appName("grainmill").getOrCreate(), config).run()
    except Exception as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
