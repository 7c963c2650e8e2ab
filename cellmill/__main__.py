"""Commands over a corpus: inspect, materialize, draft-schema, canonicalize, corpus-validate, recalc-hvg, gc."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .packaging import ship
from .sources import build as bu
from .sources import corpus as co
from .sources import counts as cn
from .sources import ledger as le
from .sources import store as so


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("cellmill", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        p = sub.add_parser(name)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    yes = {"action": "store_true"}
    add("inspect", ("--source", {}), ("--dataset-id", {}), ("--inputs", {"help": "CSV of source, dataset_id, inspection_summary"}), ("--out", {"required": True}))
    add("materialize", ("--corpus", {"required": True}), ("--inputs", {"required": True}), ("--corpus-id", {"default": "corpus"}), ("--topology", {"choices": le.TOPOLOGIES, "default": "aggregate"}), ("--format", {"choices": le.FORMATS, "default": "parquet"}), ("--n-hvg", {"type": int, "default": bu.N_HVG}), ("--rerun-inspection", yes), ("--dry-run", yes))
    add("draft-schema", ("--corpus", {"required": True}), ("--force-all", yes))
    add("canonicalize", ("--corpus", {"required": True}), ("--dataset-id", {}), ("--dry-run", yes), ("--overwrite", yes))
    add("corpus-validate", ("--corpus", {"required": True}), ("--format", {}))
    add("recalc-hvg", ("--corpus", {"required": True}), ("--dataset-id", {"action": "append"}), ("--n-hvg", {"type": int, "default": bu.N_HVG}), ("--update-manifests", {"action": argparse.BooleanOptionalAction, "default": True}))
    add("gc", ("--corpus", {"required": True}), ("--delete", yes))
    return out


def run(spark: SparkSession, arguments: list[str]) -> int:
    """Runs a command and says what it did; 1 if something failed."""
    ship(spark)
    a = parser().parse_args(arguments)
    inputs = [tuple(r) for r in so.read_inputs(spark, a.inputs).collect()] if getattr(a, "inputs", None) else []  # one row a dataset
    if a.command == "inspect":
        todo = [(s, d) for s, d, _ in inputs] or [(a.source, a.dataset_id)]
        for source, dataset_id in todo:
            print(bu.inspect_to(spark, cn.read_source(spark, source), dataset_id, a.out))
    elif a.command == "materialize":
        if co.exists(spark, f"{a.corpus}/{co.INDEX}") and bu.corpus_kind(spark, a.corpus) != (a.format, a.topology):
            raise ValueError(f"the corpus is {bu.corpus_kind(spark, a.corpus)}")
        rows = [(s, d, None if a.rerun_inspection else path) for s, d, path in inputs]
        options = {} if a.dry_run else {"n_hvg": a.n_hvg}
        for m in bu.materialize_all(spark, a.corpus, rows, a.corpus_id, a.topology, a.format, a.dry_run, **options):
            print(f"{m.dataset_id}: {m.route}, {m.cell_count} cells, {m.feature_count} genes")
    elif a.command == "draft-schema":
        print(bu.draft_all(spark, a.corpus, a.force_all))
    elif a.command == "canonicalize":
        done, failed = bu.canonicalize_all(spark, a.corpus, a.dataset_id, a.dry_run, a.overwrite)
        for r in done:
            print(f"{r.dataset_id}: {r.obs_rows} cells, {r.var_rows} genes, {r.vocabulary_size} in the vocabulary", *r.warnings)
        for d, why in failed.items():
            print(f"{d} failed: {why}", file=sys.stderr)
        return int(bool(failed))
    elif a.command == "corpus-validate":
        found = co.violations(spark, a.corpus, a.format)
        print("\n".join(found) if found else "no violations")
        return int(bool(found))
    elif a.command == "recalc-hvg":
        for d, n in bu.recalculate_hvg(spark, a.corpus, a.dataset_id, a.n_hvg, a.update_manifests).items():
            print(f"{d}: {n} cells")
    else:
        ledger = le.read_ledger(spark, f"{a.corpus}/{co.INDEX}")
        print("\n".join(le.collect_garbage(spark, a.corpus, ledger, dry_run=not a.delete)))
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
