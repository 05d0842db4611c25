"""From measurements to checks, verdict, score and report, in one plan: all gates of all projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from ..storage import stored

#: What a project gets from a gate for which it has no measurements: nothing to look at is skipped, but these look at the output itself.
NOTHING = {"no-broken-chars": "pass", "contrast": "fail", "outline-toc": "fail", "metadata": "fail", "file-size": "fail"}
#: The inputs of the gates that take more than one.
INPUTS = {"assets-exist": ("references", "existing"), "outline-toc": ("titles", "outline", "targets", "ids"), "no-bonus-in-body": ("lines", "bodies")}


def checks(projects: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """projects: project. inputs: a gate's measurements under its id, or under the names in INPUTS; each has `project`. One row for each project and
    gate: project, pos, id, status, evidence, coverage (of text-coverage). A gate without input gives NOTHING's status, or skipped."""
    if "text-coverage" in inputs:
        inputs = inputs | {"text-coverage": stored(inputs["text-coverage"], "coverage")}  # read twice
    found = []
    for name in gates.GATES:
        needed = INPUTS.get(name, (name,))
        if all(x in inputs for x in needed):
            found.append(gates.REGISTRY[name](*(inputs[x] for x in needed)))
    rows = reduce(DataFrame.unionByName, found) if found else projects.select("project", *(F.lit("").alias(c) for c in ("id", "status", "evidence"))).limit(0)
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(x).alias("id"), F.lit(NOTHING.get(x, "skipped")).alias("nothing")) for i, x in enumerate(gates.GATES)))
    every = projects.select("project").distinct().select("project", F.inline(each))
    out = every.join(rows, ["project", "id"], "left").select("project", "pos", "id", F.coalesce("status", "nothing").alias("status"), "evidence")
    if "text-coverage" not in inputs:
        return out.withColumn("coverage", F.lit(None).cast("double"))
    measured = inputs["text-coverage"].select("project", F.lit("text-coverage").alias("id"), "coverage")
    return out.join(measured, ["project", "id"], "left").select("project", "pos", "id", "status", "evidence", F.when(F.col("status") != "skipped", F.col("coverage")).alias("coverage"))


def results(rows: DataFrame) -> DataFrame:
    """rows: checks(). Verdict, counts and score of each project."""
    rows = stored(rows, "checks")  # one row for each project and gate
    return gates.verdicts(rows).join(gates.scores(rows), "project")


def report(rows: DataFrame) -> DataFrame:
    """rows: checks(). project, text: a Markdown report of the verdict, a line for each gate, and the score."""
    rows = stored(rows, "checks")
    found = results(rows)
    cell = F.replace(F.coalesce("evidence", F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), "id", F.lit(" | "), "status", F.lit(" | "), cell, F.lit(" |"))
    lines = rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))  # as many as there are gates
    parts = {"Content": ("content", 25), "Typography": ("typography", 20), "Layout": ("layout", 20), "Consistency": ("consistency", 15), "Technical": ("technical", 10), "Niche fit": ("niche_fit", 10)}
    scored = [F.concat(F.lit(f"| {name} | "), F.col(c).cast("string"), F.lit(f"/{most} |")) for name, (c, most) in parts.items()]
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Quality of "), F.col("project").cast("string")), F.lit(""), F.concat(F.lit("## Result: "), "verdict"), F.lit(""), F.lit("| Gate | Status | Evidence |"), F.lit("|---|---|---|"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit(""), F.concat(F.lit("## Score: "), F.col("total").cast("string"), F.lit("/100")), F.lit(""), F.lit("| Dimension | Score |"), F.lit("|---|---|"), *scored, F.lit(""),
    )
    return found.join(lines, "project").select("project", text.alias("text"))
