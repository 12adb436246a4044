"""SQL for DuckDB, the check's oracle, from templates whose parts Spark SQL can also render.

Queries are functions; their oracles stand here and in the modules of this package as templates. A few
queries read a driver table through a part of a template (points, ways, buffers). A template names a driver table as {table} and uses macros where the dialects differ:
@rint(x), @pct(v, p), @div(a, b), @series(a, b) (one row per integer), @at(array, i) from 0.
Spark reads the tables' files directly, so pushdown and pruning reach the scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "rint": lambda x: f"rint({x})",
    "pct": lambda v, p: f"percentile({v}, {p})",
    "div": lambda a, b: f"(({a}) div ({b}))",
    "series": lambda a, b: f"explode(sequence({a}, {b}))",
    "at": lambda a, i: f"element_at({a}, CAST({i} AS INT) + 1)",
    "json": lambda c, k: f"get_json_object({c}, '$.{k}')",
    "set": lambda x: f"array_sort(collect_set({x}))",
    "regex": lambda c, p, r: f"regexp_replace({c}, {p}, {r})",
}
DUCK = {
    "rint": lambda x: f"round_even({x}, 0)",
    "pct": lambda v, p: f"quantile_cont({v}, {p})",
    "div": lambda a, b: f"CAST(({a}) // ({b}) AS BIGINT)",
    "series": lambda a, b: f"unnest(generate_series({a}, {b}))",
    "at": lambda a, i: f"{a}[CAST({i} AS INT) + 1]",
    "json": lambda c, k: f"json_extract_string({c}, '$.{k}')",
    "set": lambda x: f"list_sort(list_distinct(list({x})))",
    "regex": lambda c, p, r: f"regexp_replace({c}, {p}, {r}, 'g')",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening bracket is at ``at``, and where it ends."""
    depth, quoted, start, out = 0, False, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        if quoted:
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"unbalanced call in {text[at:at + 40]!r}")


def render(template: str, macros: dict[str, Callable[..., str]]) -> str:
    while found := re.search(r"@(\w+)(?=\()", template):
        args, end = _arguments(template, found.end())
        template = template[: found.start()] + macros[found[1]](*args) + template[end:]
    return template


def spark_query(template: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", render(template, SPARK)))

    return run


def duck_query(template: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", render(template, DUCK))


def oracles(templates: dict[str, str]) -> dict[str, str]:
    """Oracle SQL of templates by name."""
    return {k: duck_query(v) for k, v in templates.items()}
