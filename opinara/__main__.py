"""Command line: ``python -m opinara list | run NAME | sql NAME | report | tasks``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence


def main(args: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="opinara")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    verbs.add_parser("tasks", help="named analysis tasks and their sources")
    one = verbs.add_parser("run", help="run a query over a folder of tables")
    one.add_argument("name")
    one.add_argument("--tables", required=True)
    one.add_argument("--out", help="Parquet folder for the result; without it 20 rows are shown")
    sql = verbs.add_parser("sql", help="the SQL of a query")
    sql.add_argument("name")
    rep = verbs.add_parser("report", help="the text report")
    rep.add_argument("--tables", required=True)
    for v in (one, rep):
        v.add_argument("--master", default=None)
    a = p.parse_args(args)
    from opinara.plans import catalogue

    if a.verb == "list":
        print("\n".join(sorted(catalogue.queries())))
    elif a.verb == "tasks":
        from opinara.plans.tasks import TASKS

        for t in TASKS.values():
            print(t.name, t.variant, t.matrix, t.period, " ".join(s for r in t.regions for s in r.sources()))
    elif a.verb == "sql":
        print(catalogue.oracle_sql().get(a.name, "no SQL"))
    else:
        from opinara.plans.report import build_report
        from opinara.session import build_session

        spark = build_session("opinara", a.master)
        if a.verb == "report":
            print(build_report(spark, a.tables))
        else:
            df = catalogue.queries()[a.name](spark, a.tables)
            df.write.parquet(a.out) if a.out else df.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
