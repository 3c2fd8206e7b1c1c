"""Command line: plan a query, run it under its budget, or check a telemetry log."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from costplan.plans.shape import QueryRequest
from costplan.planner import Planner
from costplan.run.adaptive import AdaptiveConfig, AdaptiveController, cheaper_replanner
from costplan.run.runner import Executor, PlanToRun
from costplan.sources import profiles, tables
from costplan.sources.logs import JsonLog, problems


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="costplan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "run"):
        c = sub.add_parser(name)
        c.add_argument("--data", required=True, help="folder of Parquet tables")
        c.add_argument("--sql", required=True)
        c.add_argument("--budget", type=float, required=True)
        c.add_argument("--deadline", type=float)
        c.add_argument("--profile")
        c.add_argument("--env", help="YAML file of profiles")
        c.add_argument("--mode", choices=("exhaustive", "beam", "none"), default="beam")
        c.add_argument("--width", type=int, default=40)
        c.add_argument("--limit", type=int, default=48)
        c.add_argument("--workers", type=int, default=4)
        c.add_argument("--log", help="JSON lines of executions")
    c = sub.add_parser("check-telemetry")
    c.add_argument("log")
    return p


def main(arguments: Sequence[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "check-telemetry":
        bad = 0
        with open(a.log) as f:
            for n, line in enumerate(f, 1):
                try:
                    wrong = problems(json.loads(line))
                except ValueError:
                    wrong = ["not JSON"]
                bad += bool(wrong)
                if wrong:
                    print(f"{n}: {'; '.join(wrong)}")
        print(f"{bad} bad records")
        return int(bad > 0)
    spark = profiles.build_session(profiles.load_environment(a.env, a.profile))
    tables.register(spark, a.data)
    plan = Planner(spark, mode=a.mode, width=a.width, limit=a.limit, workers=a.workers).plan(QueryRequest("Q", a.sql, a.budget, a.deadline))
    print(plan.message)
    for s in sorted(plan.scored, key=lambda s: (s.cost, s.plan_id)):
        print(f"{s.plan_id} {s.candidate.strategy}: cost {s.cost:.6f}, latency {s.latency:.3f} s{' *' if plan.chosen is s else ''}")
    if a.command == "plan" or plan.chosen is None:
        return int(not plan.feasible)
    pool = [PlanToRun("Q", s.plan_id, s.candidate.sql, s.candidate.strategy, s.cost, s.latency) for s in plan.scored]
    done = AdaptiveController(Executor(spark, log=JsonLog(a.log) if a.log else None), AdaptiveConfig(), cheaper_replanner(pool)).run(plan.to_run())
    print(f"{done.status} ({done.mode}) in {done.latency_seconds:.3f} s, cost {done.actual_cost}")
    return int(done.status not in ("ok", "simulated"))


if __name__ == "__main__":
    sys.exit(main())
