"""python -m causaria build | accumulate | follow | validate | decorate PROJECT"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import build as runs
from .plans import plan as plans
from .plans.validate import summary, validate
from .sources import files, project, records, state, versions


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="causaria", description=__doc__)
    a.add_argument("command", choices=("build", "accumulate", "validate", "decorate", "follow"))
    a.add_argument("project", type=Path)
    a.add_argument("--seed", type=int, help="42 for a build; a cycle goes on with the state's")
    a.add_argument("--plan", type=Path, help="an authored plan for the cycle")
    a.add_argument("--plans", help="a folder of plans that follow runs, a cycle each, each once")
    a.add_argument("--units", type=int, default=1, help="cycle units that the window spans")
    a.add_argument("--base", help="the version that all rows of must still be there: a folder, or a version of the project's log (a number or name, main~1 for the one before), of which the common ancestor with main is taken")
    o = a.parse_args(argv)
    spark, p = SparkSession.builder.appName("causaria").getOrCreate(), project.load(o.project)
    if o.command == "build":
        built = runs.build(spark, p, o.seed if o.seed is not None else 42)
        runs.write(p, built)
        print(f"built {', '.join(f'{n}: {c}' for n, c in built.checkpoint.counts.items())}")
        return 0
    runs.recovered(spark, p)
    names = list(state.load_checkpoint(p.output / runs.CHECKPOINT).counts) if (p.output / runs.CHECKPOINT).exists() else []
    if o.command == "accumulate":
        done = runs.next_cycle(spark, p, plans.load(o.plan) if o.plan else None, o.seed, o.units)
        runs.commit(spark, p, done, records.read(spark, p.domain, str(p.output), names))
        print(f"as of {done.checkpoint.as_of}: {', '.join(f'{n}: {c}' for n, c in done.checkpoint.counts.items())}")
        return 0
    if o.command == "follow":
        runs.stream_plans(spark, p, o.plans, f"{p.output}/_stream").awaitTermination()
        print(f"as of {runs.as_of(p)}")
        return 0
    data = records.read(spark, p.domain, str(p.output), names)
    if o.command == "decorate":
        cats = runs._catalogues(spark, p)
        for n, df in data.items():
            e = p.domain.entity(n)
            if any(f.generator for f in e.fields):
                records.replaced(spark, f"{p.output}/{n}", records.decorated(df, e, e.primary[0], o.seed if o.seed is not None else 42, cats))
        return 0
    bases: dict = {}
    if o.base:
        bases = {n: state.base(spark, o.base, n) for n in data} if files.exists(spark, o.base) else versions.base(spark, str(p.output), o.base, list(data))
    also = {n: project.catalogue(spark, f) for n, f in p.catalogues.items()}
    found = validate(p.domain, data, p.rules.get("factors", []), {n: b for n, (b, _) in bases.items()} if o.base else None, heroes=p.rules.get("heroes", []), ruleset=p.rules, catalogues=also, names=project.given_names(also), base_errors={n: e for n, (_, e) in bases.items() if e})
    print(summary(found))
    return int(found.where("NOT passed").count() > 0)


if __name__ == "__main__":
    sys.exit(main())
