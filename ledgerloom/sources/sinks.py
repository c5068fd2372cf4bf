"""Sinks: refreshed tables, the annotated CSV, small reports and registries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def refresh(df: DataFrame, root: str, layer: str, name: str) -> str:
    """Drop and recreate a table of a layer."""
    path = f"{root}/{layer}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def column_kinds(df: DataFrame, distinct: int = 30) -> dict[str, str]:
    """continuous for numbers, discrete for texts of at most `distinct` values and booleans, else string."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counts = df.agg(*(F.countDistinct(c).alias(c) for c in texts)).first() if texts else {}
    return {f.name: "continuous" if isinstance(f.dataType, T.NumericType) else "discrete" if isinstance(f.dataType, T.BooleanType) or (f.name in texts and counts[f.name] <= distinct) else "string" for f in df.schema}


def annotated_csv(df: DataFrame, path: str, label: str, meta: list[str], order: str) -> None:
    """One CSV file with three header rows: names, kinds, and roles (class, meta or nothing)."""
    kinds = column_kinds(df)
    kinds[label] = "discrete"
    role = lambda c: "class" if c == label else "meta" if c in meta else ""
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x
    heads = [",".join(map(quoted, df.columns)), ",".join(kinds[c] for c in df.columns), ",".join(map(role, df.columns))]
    head = df.sparkSession.createDataFrame([(-1, i, h) for i, h in enumerate(heads)], "_part int, _at long, value string")
    line = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"nullValue": "", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    body = df.select(F.lit(0).alias("_part"), F.col(order).cast("long").alias("_at"), line.alias("value"))
    # the format asks for one file
    head.unionByName(body).repartition(1).sortWithinPartitions("_part", "_at").select("value").write.mode("overwrite").text(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A small report (counts, reconciliation, dictionary, metrics) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small report table."""
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in df.limit(rows).collect())


def registry_json(registry: DataFrame) -> str:
    """The metric registry (key, value) with sorted keys; whole numbers without a point."""
    clean = lambda v: int(v) if v is not None and float(v).is_integer() else v
    return json.dumps({r.key: clean(r.value) for r in registry.collect()}, sort_keys=True, ensure_ascii=False, indent=1)


def render(template: str, registry: dict[str, float]) -> str:
    """{{key|format}} with pct, brl, dec, dec1 or milhar in Brazilian notation; a missing key is an error."""
    import re

    def comma(x: str) -> str:
        return x.replace(",", "\0").replace(".", ",").replace("\0", ".")

    shapes = {"pct": lambda v: comma(f"{v:,.2f}") + " %", "brl": lambda v: "R$ " + comma(f"{v:,.2f}"), "dec": lambda v: comma(f"{v:,.2f}"), "dec1": lambda v: comma(f"{v:,.1f}"), "milhar": lambda v: comma(f"{v:,.0f}")}
    return re.sub(r"\{\{([^|}]+)(?:\|(\w+))?\}\}", lambda m: shapes[m[2] or "milhar"](registry[m[1].strip()]), template)
