"""Metrics of source code: counts by expressions, structure by Python's ast in batches of files.

Structure is measured for Python sources only; for other languages, and for text that does not parse, it is null.
"""

from __future__ import annotations

import ast
import io
import math
import tokenize
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: what starts a test case and what asserts, by language.
TEST_CASE = {"Python": r"(?m)^\s*def test_", "Java": r"@Test", "JavaScript": r"\b(it|test)\(", "TypeScript": r"\b(it|test)\(", "Go": r"(?m)^func Test", "Ruby": r"(?m)^\s*(it|test) "}
#: Languages by file name extension.
EXTENSIONS = {"py": "Python", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go", "rb": "Ruby"}
ASSERT = r"\bassert\w*\b|\bAssert\.\w+|\bexpect\s*\("
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)
_NESTED = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)


def physical_lines(text: Column) -> Column:
    """Lines of a text; 0 for null or empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))).cast("long")


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor only a comment."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?!#|//|/\*|\*|$)\S.*$")), F.lit(0)).cast("long")


def test_cases(text: Column, language: Column) -> Column:
    """Test cases by the language's pattern; 0 for other languages."""
    out = F.lit(0)
    for name, pattern in TEST_CASE.items():
        out = F.when(language == name, F.regexp_count(text, F.lit(pattern))).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("long")


def language_of(path: Column) -> Column:
    """A file's language by its extension; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.(\w+)$", 1)))


def asserts(text: Column) -> Column:
    """Assertions in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(ASSERT)), F.lit(0)).cast("long")


def _cyclomatic(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, _BRANCHES)
        if isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.match_case):
            n += 1
    return n


def _depth(node: ast.AST) -> int:
    best, stack = 0, [(node, 0)]
    while stack:
        x, d = stack.pop()
        d += isinstance(x, _NESTED)
        best = max(best, d)
        stack += [(c, d) for c in ast.iter_child_nodes(x)]
    return best


def _halstead(text: str) -> float:
    seen: Counter = Counter()
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tokenize.NAME, tokenize.NUMBER, tokenize.STRING, tokenize.OP):
            seen[t.type, t.string] += 1
    return sum(seen.values()) * math.log2(len(seen)) if len(seen) > 1 else 0.0


def _unused(tree: ast.AST) -> int:
    """Names that a function assigns and never reads."""
    total = 0
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            stored = {x.id for x in ast.walk(f) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
            loaded = {x.id for x in ast.walk(f) if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Store)}
            outer = {n for x in ast.walk(f) if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
            total += len({n for n in stored - loaded - outer if not n.startswith("_")})
    return total


def _name(x: ast.AST) -> str | None:
    """The last part of a name."""
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None


def _class_facts(c: ast.ClassDef) -> dict:
    """Lines, complexity, foreign attributes, cohesion, bases and coupling of a class."""
    methods = [m for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    own = [{x.attr for x in ast.walk(m) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"} for m in methods]
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    tied = sum(bool(a & b) for a, b in pairs)
    foreign = {(x.value.id, x.attr) for m in methods for x in ast.walk(m) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id not in ("self", "cls")}
    calls = {x.func.id for m in methods for x in ast.walk(m) if isinstance(x, ast.Call) and isinstance(x.func, ast.Name)}
    return {"loc": c.end_lineno - c.lineno + 1, "wmc": sum(map(_cyclomatic, methods)), "atfd": len(foreign), "tcc": tied / len(pairs) if pairs else 1.0, "lcom": max(0, len(pairs) - 2 * tied), "bases": [b for b in map(_name, c.bases) if b], "uses": sorted(calls), "fan_out": len(calls)}


FILE_METRICS = "parsed boolean, cyclomatic bigint, nesting bigint, halstead double, unused_vars bigint, longest_method bigint, methods bigint, classes array<struct<name:string,loc:bigint,wmc:bigint,atfd:bigint,tcc:double,lcom:bigint,bases:array<string>,uses:array<string>,fan_out:bigint>>, error string"


def measure(text: str | None) -> dict:
    """All structural metrics of one Python source; ``error`` says why they are missing."""
    try:
        tree = ast.parse(text or "")
        functions = [x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        return {
            "parsed": True, "cyclomatic": sum(map(_cyclomatic, functions)), "nesting": _depth(tree), "halstead": _halstead(text or ""), "unused_vars": _unused(tree),
            "longest_method": max((x.end_lineno - x.lineno + 1 for x in functions), default=0), "methods": len(functions),
            "classes": [{"name": c.name} | _class_facts(c) for c in ast.walk(tree) if isinstance(c, ast.ClassDef)], "error": None,
        }
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError, MemoryError) as e:
        return {"parsed": False, "error": f"{type(e).__name__}: {e}"}


def file_metrics(files: DataFrame, keys: list[str], text: str = "text", language: str | None = None) -> DataFrame:
    """``keys`` and the structural metrics of each file. Equal texts should be made distinct before."""
    fields = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split()[0] for f in ("parsed x", "cyclomatic x", "nesting x", "halstead x", "unused_vars x", "longest_method x", "methods x", "classes x", "error x")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [measure(t) if lang in (None, "Python") else {"parsed": False, "error": f"no analyser for {lang}"} for t, lang in zip(b["_t"], b["_lang"], strict=True)]
            out = b[keys].copy()
            for n in names:
                out[n] = pd.Series([g.get(n) for g in got], index=out.index, dtype=object)
            yield out

    lang = F.col(language) if language else F.lit(None).cast("string")
    return files.select(*keys, F.col(text).alias("_t"), lang.alias("_lang")).mapInPandas(run, f"{fields}, {FILE_METRICS}")


def class_smells(metrics: DataFrame, group: str) -> DataFrame:
    """Classes with ``large_class`` (lines at or above the group's 90th percentile) and ``god_object``."""
    classes = metrics.select("*", F.explode("classes").alias("c")).select(*[c for c in metrics.columns if c != "classes"], "c.*")
    cuts = classes.groupBy(group).agg(F.percentile("loc", F.lit(0.9)).alias("_loc"), F.percentile("wmc", F.lit(0.75)).alias("_wmc"))
    j = classes.join(cuts, group)
    return j.withColumns({"large_class": F.col("loc") >= F.col("_loc"), "god_object": (F.col("atfd") > 5) & (F.col("wmc") >= F.col("_wmc")) & (F.col("tcc") < 1 / 3)}).drop("_loc", "_wmc")


def class_hierarchy(metrics: DataFrame, group: list[str]) -> DataFrame:
    """``group``, ``name``, ``dit`` and ``fan_in`` of the classes of a snapshot, one task a snapshot.

    ``dit``: the longest chain of bases among the snapshot's classes, one step for a base from outside, 0 without bases;
    cycles end where they close. ``fan_in``: other classes of the snapshot that call the class. Names are bare names; of
    classes with one name the bases are joined.
    """
    classes = metrics.select(*group, F.explode("classes").alias("c")).select(*group, "c.name", "c.bases", "c.uses")
    fields = ", ".join(f"`{k}` {metrics.schema[k].dataType.simpleString()}" for k in group)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        bases: dict[str, set[str]] = {}
        users: dict[str, set[str]] = {}
        for name, b, uses in zip(g["name"], g["bases"], g["uses"], strict=True):
            bases.setdefault(name, set()).update(b)
            for u in uses:
                users.setdefault(u, set()).add(name)
        depth: dict[str, int] = {}

        def of(name: str, above: frozenset[str]) -> int:
            if name not in bases or name in above:
                return 0
            if name not in depth:
                depth[name] = max((1 + of(b, above | {name}) for b in bases[name]), default=0)
            return depth[name]

        rows = [(n, of(n, frozenset()), len(users.get(n, set()) - {n})) for n in sorted(bases)]
        out = pd.DataFrame(rows, columns=["name", "dit", "fan_in"])
        for i, k in enumerate(group):
            out.insert(i, k, g[k].iloc[0])
        return out

    return classes.groupBy(*group).applyInPandas(run, f"{fields}, name string, dit bigint, fan_in bigint")


def long_method(metrics: DataFrame, most: int = 100) -> DataFrame:
    """Adds whether a file has a method of more than ``most`` lines."""
    return metrics.withColumn("long_method", F.col("longest_method") > most)


def duplicate_code(files: DataFrame, key: list[str], text: str = "text", tokens: int = 50) -> DataFrame:
    """Runs of ``tokens`` tokens that occur more than once: ``key``, ``place`` of the run and the number of ``copies``.

    Runs are matched by hash; the count of a run is an aggregation, so copies are never paired.
    """
    from prlens.functions.text import once

    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+|(?<=\W)|(?=\W)"), lambda x: F.trim(x) != "")
    hashes = once(words, lambda w: F.when(F.size(w) >= tokens, F.transform(F.sequence(F.lit(1), F.size(w) - (tokens - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(tokens))))))
    runs = files.select(*key, F.posexplode(hashes).alias("place", "_h"))
    copies = runs.groupBy("_h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return runs.join(copies, "_h").select(*key, F.col("place").cast("long").alias("place"), "copies")


def smell_density(smells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Smells by kind per 1000 lines of a snapshot (``lines``); architecture smells per component (``components``)."""
    counts = smells.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))
    size = F.when(F.col("kind") == "architecture", F.col("components").cast("double")).otherwise(F.col("lines") / F.lit(1000.0))
    return counts.join(sizes.select(*keys, "lines", "components"), keys).select(*keys, "kind", "n", F.try_divide(F.col("n"), size).alias("density"))


def snapshot_covariates(files: DataFrame, keys: list[str], text: str = "text", language: str | None = None) -> DataFrame:
    """Files, physical and code lines, and per 1000 code lines the test lines, test cases and assertions of each snapshot.

    Test cases and assertions count in test files only, by the file's ``language`` (by its extension where none is given).
    """
    from prlens.functions.text import TEST_FILE

    is_test = F.coalesce(F.col("path").rlike(TEST_FILE), F.lit(False))
    code = code_lines(F.col(text))
    lang = F.col(language) if language else language_of(F.col("path"))
    agg = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum(physical_lines(F.col(text))).alias("loc"), F.sum(code).alias("sloc"), F.sum(F.when(is_test, code).otherwise(0)).alias("_t"),
        F.sum(F.when(is_test, test_cases(F.col(text), lang)).otherwise(0)).alias("_c"), F.sum(F.when(is_test, asserts(F.col(text))).otherwise(0)).alias("_a"),
    )
    per = lambda c: F.try_divide(F.col(c) * 1000.0, F.col("sloc"))
    return agg.select(*keys, "files", "loc", "sloc", per("_t").alias("test_lines_per_kloc"), per("_c").alias("test_cases_per_kloc"), per("_a").alias("asserts_per_kloc"))


def introduced_in(findings: DataFrame, added: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per pull request the findings (``start_line``, ``end_line``, ``rule``) that touch lines it added (``from_line``, ``to_line``)."""
    from prlens.operators.joins import line_overlap

    return line_overlap(findings.select(*keys, "rule", "start_line", "end_line"), added, keys).groupBy(keys[0]).agg(F.count(F.lit(1)).alias(name))


def net_change(head: DataFrame, base: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Head minus base of a summed file metric by ``key``; a side without files counts 0."""
    total = lambda d, n: d.groupBy(key).agg(F.sum(value).alias(n))
    return total(head, "_h").join(total(base, "_b"), key, "full_outer").select(key, (F.coalesce("_h", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias(name))
