"""Sinks: CSV with describing names, split outputs, resumable snapshot folders, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.functions.text import LANGUAGE_TAGS

def language_tag(language: str) -> str:
    """A language's tag in file names; the rule of :func:`prlens.functions.text.language_tag` for one name."""
    low = language.strip().lower()
    return LANGUAGE_TAGS.get(low, agent_tag(low))


def agent_tag(agent: str) -> str:
    """An agent's tag in file names: letters and digits."""
    return re.sub(r"[\W_]", "", agent.lower())


#: The settings that a file name tells of, in order, with their defaults and how a name shows others.
SETTINGS = {
    "star_minimum": (100, "{}"), "language": (None, lambda v: "".join(map(language_tag, v.split(",")))), "agents": (None, lambda v: "".join(map(agent_tag, v))),
    "user_minimum": (None, "u{}"), "forks_minimum": (None, "f{}"), "age_minimum": (None, "amin{}"), "age_maximum": (None, "amax{}"),
    "rejected": (True, "allstates"), "english_title": (True, "alllangs"), "require_body": (True, "allbodies"), "require_live_url": (True, "deadlinks"),
}


def descriptor(**settings: object) -> str:
    """What differs from the defaults of ``SETTINGS``, joined by hyphens; ``default`` if nothing does."""
    if unknown := settings.keys() - SETTINGS.keys():
        raise TypeError(f"no such settings: {sorted(unknown)}")
    shown = [(form, settings.get(name, default)) for name, (default, form) in SETTINGS.items() if settings.get(name, default) not in (default, None, "", [])]
    return "-".join(form(v) if callable(form) else form.format(v) for form, v in shown) or "default"


def output_name(day: str, settings: str, count: int) -> str:
    """``MM-DD-<settings>-<count>.csv`` for a day written YYYY-MM-DD."""
    return f"{day[5:10]}-{settings}-{count}.csv"


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; ``single`` joins the parts, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not in ``done``; for resuming."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def write_snapshots(df: DataFrame, path: str, keys: tuple[str, ...] = ("repo", "commit_sha")) -> None:
    """Append snapshots in folders by their keys."""
    df.write.mode("append").partitionBy(*keys).parquet(path)


def safe_name(name: str) -> str:
    """A repository's name as a folder."""
    return re.sub("/", "__", name)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A result of at most ``most`` rows as a Markdown table; a longer one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def report(sections: dict[str, DataFrame], title: str) -> str:
    """Small results as one Markdown report, a heading and a table each."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"
