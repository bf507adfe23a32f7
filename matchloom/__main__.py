"""Command line: ``python -m matchloom --config settings.yaml [--step download|train|evaluate|all] [-v]``."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .config import load_config
from .pipeline import run_download, run_pipeline


def _matching(step: str) -> Callable[[dict], dict[str, Any]]:
    def run(settings: dict) -> dict[str, Any]:
        return run_pipeline(SparkSession.builder.appName("matchloom").getOrCreate(), settings, step)

    return run


#: What each step does with the settings, and what it prints.
STEPS: dict[str, Callable[[dict], dict[str, Any]]] = {"download": lambda settings: {"tables": len(run_download(settings))}, **{step: _matching(step) for step in ("train", "evaluate", "all")}}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="matchloom", description="Match the records of two tables.")
    parser.add_argument("--config", required=True, help="settings in YAML")
    parser.add_argument("--step", choices=tuple(STEPS), default="all")
    parser.add_argument("-v", "--verbose", action="store_true", help="log details")
    args = parser.parse_args(argv)
    logging.basicConfig(format="%(levelname)s %(name)s: %(message)s")
    logging.getLogger("matchloom").setLevel(logging.DEBUG if args.verbose else logging.INFO)
    settings = load_config(args.config)
    if args.step == "evaluate" and not Path(settings["pipeline.artifacts_dir"], "model").exists():
        print("no trained model; run --step train first", file=sys.stderr)
        return 1
    for name, value in STEPS[args.step](settings).items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
