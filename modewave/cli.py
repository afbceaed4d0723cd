"""Command line: surface, surface-export, batch, column, column-replot, host-layout, replot, replot-batch, preflight."""

from __future__ import annotations

import argparse
import json

from .plans import column, products, surface
from .session import session
from .sources import arrays
from .sources.config import batch_config, column_config, read_json, surface_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modewave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(f"--{o}", required=True)
        return s

    for name in ("surface", "batch", "surface-preflight"):
        s = add(name, "config", "surface-root", *(["output-root"] if name != "surface-preflight" else []))
        s.add_argument("--allow-partial-months", action="store_true")
        s.add_argument("--allow-trial", action="store_true")
        if name == "batch":
            s.add_argument("--skip-existing", action="store_true")
        if name == "surface":
            s.add_argument("--parquet", action="store_true", help="the root holds exported tables, on any store")
    s = add("surface-export", "config", "surface-root", "output-root")
    s.add_argument("--allow-partial-months", action="store_true")
    s.add_argument("--allow-trial", action="store_true")
    s = add("column", "config", "native-root", "surface-root", "output-root")
    s.add_argument("--allow-partial-months", action="store_true")
    s.add_argument("--allow-trial", action="store_true")
    either = s.add_mutually_exclusive_group()
    either.add_argument("--preflight", action="store_true")
    either.add_argument("--resume-partial")
    for name in ("replot", "column-replot"):
        s = add(name, "run", "config", "output-root", "bundle")
        s.add_argument("--mode-from", type=int, default=1)
        s.add_argument("--mode-to", type=int, default=5 if name == "replot" else 20)
    s = add("replot-batch", "output-root", "bundle")
    s.add_argument("--job", nargs=2, action="append", metavar=("RUN", "CONFIG"), required=True)
    add("host-layout", "run", "output-root")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    allow = {"allow_partial": getattr(a, "allow_partial_months", False), "allow_trial": getattr(a, "allow_trial", False)}
    if a.command == "surface":
        out = surface.run(spark, surface_config(a.config), a.surface_root, a.output_root, parquet=a.parquet, **allow)
    elif a.command == "surface-export":
        c = surface_config(a.config)
        found = arrays.months(a.surface_root, c.domain, c.input.month_ids, required=c.input.required_kinds, schema_major=c.input.schema_major, **allow)
        out = arrays.export(spark, a.surface_root, c.domain, found, a.output_root)
    elif a.command == "surface-preflight":
        out = surface.preflight(spark, surface_config(a.config), a.surface_root, **allow)
    elif a.command == "batch":
        out = products.run_batch(spark, batch_config(a.config), a.surface_root, a.output_root, skip_existing=a.skip_existing, **allow)
    elif a.command == "column" and a.preflight:
        out = column.preflight(spark, column_config(a.config), a.native_root, a.surface_root, **allow)
    elif a.command == "column":
        out = column.run(spark, column_config(a.config), a.native_root, a.surface_root, a.output_root, resume=a.resume_partial, **allow)
    elif a.command in ("replot", "column-replot"):
        out = products.replot(spark, a.run, read_json(a.config), a.output_root, a.bundle, mode_from=a.mode_from, mode_to=a.mode_to)
    elif a.command == "replot-batch":
        out = products.replot_batch(spark, [(r, read_json(c)) for r, c in a.job], a.output_root, a.bundle)
    else:
        out = products.host_layout(spark, a.run, a.output_root)
    print(out if isinstance(out, str) else json.dumps(out, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
