"""Commands over a folder of unpacked files: `python -m orebed.cli COMMAND --help`."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions import predicates
from orebed.operators import export, lookups, sprites, validate, windows
from orebed.operators.progress import observed
from orebed.session import ship
from orebed.sources import listing, sinks, text_files


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("orebed").getOrCreate()
    ship(spark)
    return spark


def _files(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    found = listing.relative(listing.files(spark, args.source), args.source)
    return found.where(predicates.passes(F.col("path"), args.include, args.exclude))


def _write(rows: DataFrame, args: argparse.Namespace) -> dict:
    written, seen = observed(sinks.write_files(rows, args.output, args.overwrite, args.started), F.col("written"))
    written.write.format("noop").mode("overwrite").save()
    return dict(seen.get)


def files(spark: SparkSession, args: argparse.Namespace) -> dict:
    found = listing.searched(_files(spark, args).select("path"), *args.search)
    count, first = listing.overview(found, args.limit)
    return {"files": count, "first": first}


def raw(spark: SparkSession, args: argparse.Namespace) -> dict:
    return _write(listing.searched(_files(spark, args), *args.search).select("path", "content"), args)


def anim(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Numbered containers, the limit before the filter; names from a mapping file."""
    ids = listing.generated(spark, 999, predicates.QUALITY_PREFIXES[args.quality], args.max_files)
    wanted = listing.present(ids, _files(spark, args))
    if args.names:
        names = text_files.names_by_id(text_files.numbered_lines(spark, args.names))
        wanted = lookups.named(wanted.withColumn("id", F.col("id").cast("int")), names, "id", "name", F.col("path")).withColumn("path", F.when(F.col("name") != F.col("path"), F.concat("name", F.lit(".anim"))).otherwise(F.col("path")))
    if not args.png:
        return _write(wanted.select("path", "content"), args)
    containers, rejects = sprites.layered_files(wanted)
    done = _write(export.exported(containers, args.layers, level=args.level), args)
    return done | {"rejects": [tuple(r) for r in windows.head(rejects, 20, "path").collect()]}


def check(spark: SparkSession, args: argparse.Namespace) -> dict:
    baselines = text_files.read_baselines(spark, args.baselines)
    checked = validate.validated(baselines, _files(spark, args)).select("sprite_name", "status")
    total = validate.detect_regressions(checked, args.strict).first()
    return {**total.asDict(), "failed_first": [r.line for r in validate.report(checked).limit(20).collect()]}


def config(spark: SparkSession, args: argparse.Namespace) -> dict:
    return json.loads(text_files.dump_config(text_files.Config()))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orebed")
    commands = parser.add_subparsers(required=True)
    for run in (files, raw, anim, check, config):
        p = commands.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run, started=time.time())
        if run is config:
            continue
        p.add_argument("source")
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--search", action="append", default=[])
        if run is files:
            p.add_argument("--limit", type=int, default=10)
        if run in (raw, anim):
            p.add_argument("--output", default=text_files.Output.directory)
            p.add_argument("--overwrite", default="Always", choices=sinks.POLICIES)
        if run is anim:
            p.add_argument("--quality", default="hd4", choices=sorted(predicates.QUALITY_PREFIXES))
            p.add_argument("--max-files", type=int)
            p.add_argument("--names")
            p.add_argument("--png", action="store_true")
            p.add_argument("--layers", action="append", default=[])
            p.add_argument("--level", type=int, default=6)
        if run is check:
            p.add_argument("--baselines", required=True)
            p.add_argument("--strict", action="store_true")
    args = parser.parse_args(argv)
    print(json.dumps(args.run(_session(), args), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
