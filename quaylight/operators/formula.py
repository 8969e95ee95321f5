"""Availability of formulas from facts."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inputs(expression: str) -> dict[str, bool]:
    """COA1: mnemonics of ``vals("X")`` calls in a formula; True where each use is
    inside ``default(...)``, so that the input may be missing."""
    out: dict[str, bool] = {}

    def walk(node: ast.AST, optional: bool) -> None:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id == "vals" and node.args and isinstance(node.args[0], ast.Constant):
                name = str(node.args[0].value)
                out[name] = out.get(name, True) and optional
                return
            optional = optional or node.func.id == "default"
        for child in ast.iter_child_nodes(node):
            walk(child, optional)

    walk(ast.parse(expression, mode="eval"), False)
    return out


def edges(formulas: dict[str, str]) -> list[tuple[str, str, bool]]:
    """COA2: (parent, child, optional) of the formulas; shared inputs make a DAG."""
    return [(parent, child, optional) for parent, text in formulas.items() for child, optional in inputs(text).items()]


def levels(formulas: dict[str, str], root: str) -> list[list[str]]:
    """COA2: mnemonics reachable from the root by height, leaves first; a cycle is an
    error."""
    below = {p: set(inputs(t)) for p, t in formulas.items()}
    height: dict[str, int] = {}

    def visit(m: str, path: tuple[str, ...]) -> int:
        if m in path:
            raise ValueError(f"formula of {m} depends on itself")
        if m not in height:
            height[m] = 1 + max((visit(c, (*path, m)) for c in below.get(m, ())), default=-1)
        return height[m]

    visit(root, ())
    return [sorted(m for m, h in height.items() if h == i) for i in range(max(height.values()) + 1)]


def availability(facts: DataFrame, formulas: dict[str, str], root: str, keys: list[str], mnemonic: str, share: float = 1.0) -> DataFrame:
    """COA3, AGG10, AGG11: whether ``root`` can be populated for each key: it has a
    value, or at least ``share`` of its required inputs can be (0: any formula can).
    One pass: the facts become a flag for each mnemonic, and the levels of the
    formula tree become expressions over the flags."""
    order = levels(formulas, root)
    flags = [F.max((F.col(mnemonic) == m).cast("int")).alias(m) for level in order for m in level]
    out = facts.groupBy(*keys).agg(*flags)
    for level in order:
        for m in level:
            if m in formulas:
                needed = [c for c, optional in inputs(formulas[m]).items() if not optional]
                met = sum((F.col(c) for c in needed), F.lit(0))
                ok = met / len(needed) >= share if needed else F.lit(True)
                out = out.withColumn(m, F.greatest(F.coalesce(F.col(m), F.lit(0)), ok.cast("int")))
    return out.select(*keys, F.coalesce(F.col(root), F.lit(0)).alias("available"))


def reachable(spark: SparkSession, tree: DataFrame, root: str) -> DataFrame:
    """COA2 in SQL: the nodes below a root with their depth, by a recursive query over
    (parent, child)."""
    tree.createOrReplaceTempView("_formula_edges")
    return spark.sql(
        """
        WITH RECURSIVE below(node, depth) AS (
            SELECT child, 1 FROM _formula_edges WHERE parent = :root
            UNION ALL
            SELECT e.child, b.depth + 1 FROM below b JOIN _formula_edges e ON e.parent = b.node
        )
        SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM below GROUP BY node
        """,
        {"root": root},
    )
