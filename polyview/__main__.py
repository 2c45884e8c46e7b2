"""Command line: run (fit a table or go on with a saved model), codebook (infer and write), summarize (a saved model)."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from polyview.engine import Engine
from polyview.plans.fit import SETS, Handler
from polyview.sources.codebook import Codebook, infer
from polyview.sources.readers import read_table, with_row_names


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="polyview", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run")
    run.add_argument("source", help="a table, or a saved model with --resume")
    run.add_argument("out")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--codebook")
    run.add_argument("-n", "--n-iters", type=int, default=100)
    run.add_argument("-s", "--n-states", type=int, default=8)
    run.add_argument("--timeout", type=float)
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--flat-columns", action="store_true")
    run.add_argument("--transitions", choices=sorted(SETS), default="default")
    run.add_argument("--row-alg", choices=("slice", "finite"), default="slice")
    book = sub.add_parser("codebook")
    book.add_argument("source")
    book.add_argument("out")
    book.add_argument("--cutoff", type=int, default=20)
    book.add_argument("--no-hypers", action="store_true")
    sub.add_parser("summarize").add_argument("model")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("polyview").getOrCreate()
    try:
        if a.what == "run":
            given = Codebook.parse(Path(a.codebook).read_text()) if a.codebook else None
            e = Engine.load(spark, a.source) if a.resume else Engine.from_df(spark, a.source, given, a.n_states, a.seed, a.flat_columns)
            e.update(a.n_iters, a.transitions, a.row_alg, handler=Handler(timeout=a.timeout))
            e.save(a.out)
        elif a.what == "codebook":
            Path(a.out).write_text(infer(with_row_names(read_table(spark, a.source)), cutoff=a.cutoff, no_hypers=a.no_hypers).json())
        else:
            e = Engine.load(spark, a.model)
            for k, s in enumerate(e.model.states):
                print(f"state {k}: {len(s.diagnostics)} iterations, {len(s.views)} views, score {sum(s.diagnostics[-1]) if s.diagnostics else float('nan'):.3f}")
    except (ValueError, IndexError, OSError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
