"""Command line: filter pull requests, attach metadata, extract repositories, select repositories, build the manifest."""

from __future__ import annotations

import argparse
import datetime

from prlens.operators import filters, selection, timegrid
from prlens.session import build_session
from prlens.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prlens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="ids of pull requests that pass the filters")
    for name in ("prs", "repos", "users", "url-status"):
        f.add_argument(f"--{name}", required=name in ("prs", "repos"))
    f.add_argument("--star-minimum", type=float, default=100)
    f.add_argument("--language")
    f.add_argument("--agents")
    for name, kind in (("user-minimum", float), ("forks-minimum", float), ("age-minimum", int), ("age-maximum", int)):
        f.add_argument(f"--{name}", type=kind)
    for name in ("all-states", "all-languages", "all-bodies"):
        f.add_argument(f"--{name}", action="store_true")
    f.add_argument("--now", help="the instant that ages refer to")
    m = sub.add_parser("metadata", help="columns of pull requests for a list of ids")
    r = sub.add_parser("repos", help="repositories of a list of ids")
    for x in (m, r):
        x.add_argument("--ids", required=True)
        x.add_argument("--prs", required=True)
    r.add_argument("--repos", required=True)
    s = sub.add_parser("select", help="repository summary and a stratified pick")
    s.add_argument("--candidates", required=True)
    s.add_argument("--prs", required=True)
    s.add_argument("--pilot-size", type=int, default=5)
    g = sub.add_parser("manifest", help="snapshots of repositories on both grids")
    g.add_argument("--repos", required=True)
    g.add_argument("--commits", required=True)
    for x in (f, m, r, s, g):
        x.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    """Run one command; inputs are Parquet, id lists are CSV, results are CSV folders under ``--out``."""
    a = _parser().parse_args(argv)
    spark = build_session("prlens")
    read = lambda path: readers.read_parquet(spark, path) if path else None
    if a.command == "filter":
        agents = [x.strip() for x in a.agents.split(",")] if a.agents else None
        ids = filters.filter_prs(
            read(a.prs), read(a.repos), read(a.users), rejected=not a.all_states, star_minimum=a.star_minimum, language=a.language or None, agents=agents, user_minimum=a.user_minimum,
            forks_minimum=a.forks_minimum, age_minimum=a.age_minimum, age_maximum=a.age_maximum, english_title=not a.all_languages, require_body=not a.all_bodies, url_status=read(a.url_status), now=a.now,
        ).cache()
        settings = sinks.descriptor(
            star_minimum=a.star_minimum if a.star_minimum % 1 else int(a.star_minimum), language=a.language, agents=agents, user_minimum=a.user_minimum, forks_minimum=a.forks_minimum, age_minimum=a.age_minimum,
            age_maximum=a.age_maximum, rejected=not a.all_states, english_title=not a.all_languages, require_body=not a.all_bodies, require_live_url=bool(a.url_status),
        )
        sinks.write_csv(ids, f"{a.out}/{sinks.output_name(datetime.date.today().isoformat(), settings, ids.count())}")
    elif a.command == "metadata":
        prs = read(a.prs)
        sinks.write_csv(filters.with_metadata(readers.read_ids(readers.read_csv(spark, a.ids)), prs, prs.columns), a.out)
    elif a.command == "repos":
        sinks.write_csv(filters.extract_repos(readers.read_ids(readers.read_csv(spark, a.ids)), read(a.prs), read(a.repos)), a.out)
    elif a.command == "select":
        table = selection.pr_table(read(a.candidates), read(a.prs))
        summary = selection.repo_summary(table).cache()
        flat = summary.withColumn("agent_breakdown", summary["agent_breakdown"].cast("string"))
        sinks.write_csv(flat, f"{a.out}/summary")
        sinks.write_csv(table, f"{a.out}/prs")
        print(sinks.markdown_table(selection.suggest_pilot(flat, a.pilot_size)))
    else:
        sinks.write_csv(timegrid.manifest(read(a.repos), read(a.commits)), a.out)


if __name__ == "__main__":
    main()
