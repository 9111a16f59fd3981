"""Command line: ``python -m ledgerloom <settings.json | dev | prod> <step> [step …]``.

The presets need ``--root`` (where layers go) and ``--csv`` (raw transactions).
``pipeline`` stands for the batch steps after ``bronze``; ``scaling`` repeats
them over the configured step ranges and shuffle widths.
"""

from __future__ import annotations

import argparse
import json

from ledgerloom.config import PRESETS, load_config, preset
from ledgerloom.plans import flow
from ledgerloom.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    parser.add_argument("settings", help="JSON settings file, or a preset: " + ", ".join(sorted(PRESETS)))
    parser.add_argument("steps", nargs="+", help="pipeline, scaling, or: " + ", ".join(sorted(flow.STEPS)))
    parser.add_argument("--root")
    parser.add_argument("--csv")
    parser.add_argument("--master")
    parser.add_argument("--shuffle-partitions", type=int)
    args = parser.parse_args()
    if args.settings in PRESETS:
        if not (args.root and args.csv):
            parser.error("a preset needs --root and --csv")
        config = preset(args.settings, args.root, args.csv)
    else:
        config = load_config(args.settings)
    spark = build_session(master=args.master, shuffle_partitions=args.shuffle_partitions)
    for name in args.steps:
        if name == "scaling":
            flow.scaling_runs(spark, config)
            continue
        names = flow.PIPELINE if name == "pipeline" else [name]
        print(json.dumps(flow.run(spark, config, names), indent=2, default=str))


if __name__ == "__main__":
    main()
