"""Edit plans: parsing, checks against files, differences and risk."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.functions import vocabulary as V
from spindle.functions.text import any_pattern

_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
ACTIONS = ("create_file", "modify_file", "delete_file", "move_file")


def plan_rows(plan_id: int, answer: str) -> list[tuple]:
    """(plan_id, pos, action, path, target_path, new_content, error) of a model's answer; one error row if it holds no plan."""
    fence = _FENCE.search(answer)
    a, b = answer.find("{"), answer.rfind("}")
    whole = fence[1] if fence else answer[a : b + 1] if -1 < a < b else None
    fail = lambda why: [(plan_id, None, None, None, None, None, why)]
    try:
        plan = json.loads(whole) if whole is not None else None
    except ValueError:
        return fail("not JSON")
    if not isinstance(plan, dict) or not isinstance(plan.get("edits"), list) or not plan["edits"]:
        return fail("no edits")
    out = []
    for pos, item in enumerate(plan["edits"]):
        if not isinstance(item, dict):
            return fail(f"edit {pos}: no object")
        action, path, target, content = (item.get(k) for k in ("action", "path", "target_path", "new_content"))
        action, path = str(action or "").strip(), str(path or "").strip()
        why = (
            f"edit {pos}: action" if action not in ACTIONS
            else f"edit {pos}: path" if not path
            else f"edit {pos}: new_content" if action in ACTIONS[:2] and content is None
            else f"edit {pos}: target_path" if action == "move_file" and not target
            else None
        )
        if why:
            return fail(why)
        out.append((plan_id, pos, action, path, str(target) if target else None, None if content is None else str(content), None))
    return out


def parsed_plans(answers: DataFrame) -> DataFrame:
    """Rows as plan_rows gives them, of answers (plan_id, answer)."""
    columns = ["plan_id", "pos", "action", "path", "target_path", "new_content", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [x for i, a in zip(rows["plan_id"], rows["answer"], strict=True) for x in plan_rows(i, a or "")]
            yield pd.DataFrame(out, columns=columns).astype({"pos": "Int64"})

    return answers.select("plan_id", "answer").mapInPandas(run, "plan_id long, pos long, action string, path string, target_path string, new_content string, error string")


def risk(action: Column, path: Column, churn: Column) -> Column:
    return (
        F.when(action.isin("delete_file", "move_file"), "high")
        .when(F.lower(path).rlike(any_pattern(V.CONFIG_HINTS)), "medium")
        .when(churn > 120, "high")
        .when(churn > 30, "medium")
        .otherwise("low")
    )


def diffs(edits: DataFrame) -> DataFrame:
    """edits (action, path, target_path, before, after) with diff, added, removed and risk."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in edits.schema), "diff string", "added long", "removed long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            diff, added, removed = [], [], []
            for r in rows.itertuples(index=False):
                before, after = r.before or "", "" if r.action == "delete_file" else r.after or ""
                new = r.target_path if r.action == "move_file" else r.path
                labels = ("/dev/null" if r.action == "create_file" else f"a/{r.path}", "/dev/null" if r.action == "delete_file" else f"b/{new}")
                text = "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), *labels))
                diff.append(text + "\n" * (text != "" and text[-1] != "\n") if text else f"# no textual change for {r.path}\n")
                marks = [x[:2] for x in difflib.ndiff(before.splitlines(), after.splitlines())]
                added.append(marks.count("+ "))
                removed.append(marks.count("- "))
            yield rows.assign(diff=diff, added=added, removed=removed)

    out = edits.mapInPandas(run, schema)
    return out.withColumn("risk", risk(F.col("action"), F.col("path"), F.col("added") + F.col("removed")))


def apply_plan(edits: DataFrame, files: DataFrame) -> DataFrame:
    """edits (path, action, target_path, expected_hash) with the status that applying them would have.

    files: (path, text). Paths that leave the root are errors; an edit whose file isn't there is
    missing; one whose file changed, or whose place is taken, is a conflict.
    """
    leaves = lambda c: F.coalesce(F.col(c).rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(False))
    here = files.select(F.col("path").alias("p"), T.content_hash(F.col("text")).alias("hash"))
    there = files.select(F.col("path").alias("q"))
    own = edits.join(here, F.col("path") == F.col("p"), "left").join(there, F.coalesce("target_path", F.lit("")) == F.col("q"), "left")
    status = (
        F.when(leaves("path") | leaves("target_path"), "error")
        .when((F.col("action") == "create_file") & F.col("p").isNotNull(), "conflict")
        .when((F.col("action") != "create_file") & F.col("p").isNull(), "missing")
        .when(F.col("expected_hash").isNotNull() & (F.col("expected_hash") != F.col("hash")), "conflict")
        .when(F.col("q").isNotNull(), "conflict")
        .otherwise("applied")
    )
    return own.select(*edits.columns, status.alias("status"))


def overall_risk(diffs_: DataFrame, by: list[str]) -> DataFrame:
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    return diffs_.groupBy(*by).agg(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.max(rank) + 1).alias("risk"))


def diff_lines(diffs_: DataFrame, key: str) -> DataFrame:
    """key, line and kind (added, removed, header or context) of each line of a diff."""
    rows = diffs_.select(key, F.posexplode(T.lines(F.col("diff"))).alias("line", "code"))
    kind = F.when(F.col("code").rlike(r"^(\+\+\+|---|@@)"), "header").when(F.col("code").startswith("+"), "added").when(F.col("code").startswith("-"), "removed").otherwise("context")
    return rows.select(key, "line", kind.alias("kind"))
