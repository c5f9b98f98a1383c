"""Command line: python -m loquela.cli COMMAND SESSION_DIR."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from loquela import config
from loquela.plans import session
from loquela.session import get_session
from loquela.sources.readers import StoredSegments


def _run(spark, root, cfg, args):
    session.run_session(spark, root, cfg, StoredSegments(args.segments or str(root / "segments.jsonl")))


COMMANDS = {
    "run": _run,
    "rebuild": lambda spark, root, cfg, args: session.run_rebuild(spark, root, cfg),
    "prepare-ai": lambda spark, root, cfg, args: session.run_prepare(spark, root, cfg),
    "ai-analyze": lambda spark, root, cfg, args: session.run_extract(spark, root, cfg, args.force) and session.run_report(spark, root, cfg),
    "build-report": lambda spark, root, cfg, args: session.run_report(spark, root, cfg),
    "build-pdf": lambda spark, root, cfg, args: session.run_chronicle(spark, root, cfg, args.force_synthesis),
}


def main(argv: list[str] | None = None) -> int:
    """0 for success, 1 for an error, 130 for an interruption."""
    parser = argparse.ArgumentParser(prog="loquela")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("session_dir", type=Path)
        p.add_argument("--config", type=Path)
        p.add_argument("--quality-profile", choices=sorted(config.PROFILES))
        p.add_argument("--limit-minutes", type=float)
        p.add_argument("--backend")
        p.add_argument("--model")
        p.add_argument("--segments", help="recognised segments (JSONL or Parquet) for run")
        p.add_argument("--force", action="store_true")
        p.add_argument("--force-synthesis", action="store_true")
        loud = p.add_mutually_exclusive_group()
        loud.add_argument("-v", "--verbose", action="store_true")
        loud.add_argument("-q", "--quiet", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING if args.quiet else logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        over = {"quality_profile": args.quality_profile, "limit_minutes": args.limit_minutes, "transcription_backend": args.backend, "model_size": args.model}
        cfg = config.load(args.session_dir, args.config, **over)
        COMMANDS[args.command](get_session(), args.session_dir, cfg, args)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:
        logging.getLogger(__name__).error("error: %s", e)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
