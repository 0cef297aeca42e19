"""Fix plans: findings that a person names, each with the action that would settle it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What settles a finding: (codes, action, phase, risk, change, whether the change is in the subject's file, words before and after the subject).
ACTIONS = [
    (["unused-file"], "delete-file", "dead-code", "medium", "delete", True, "Delete the file `", "`."),
    (["unused-export", "unused-type"], "delete-export", "dead-code", "low", "edit", True, "Remove the unused export from `", "`."),
    (["unused-dependency", "unused-package"], "remove-dependency", "dead-code", "medium", "edit", False, "Remove `", "` from package.json dependencies."),
    (["cycle"], "break-cycle", "architecture", "high", None, True, "Identify the weakest edge in the cycle involving `", "`."),
    (["boundary-violation"], "update-boundary-rule", "governance", "low", "edit", True, "Update boundary rules or refactor the import involving `", "`."),
    (["ownership-unowned", "ownership-cross-owner", "ownership-hotspot"], "assign-owner", "governance", "low", "config", False, "Assign an owner for `", "` in the ownership config."),
]
# A cycle's second step.
SECOND = {"break-cycle": ("Extract the shared dependency or invert the dependency direction.", "refactor")}
_STEP = "struct<description:string,file:string,change:string>"


def named(found: DataFrame, targets: list[str]) -> DataFrame:
    """Findings whose id is a target, or whose subject starts with one (so also those of an export of a file that is a target)."""
    hits = [(F.col("id") == t) | F.col("subject").startswith(t) for t in targets]
    return found.where(reduce(Column.__or__, hits, F.lit(False)))


def fix_actions(found: DataFrame) -> DataFrame:
    """(id, finding_id, action, target, phase, risk, confidence, steps) of findings; those of other codes have a null action and no steps: nothing is known to settle them."""
    subject, code = F.col("subject"), F.col("code")
    file = F.substring_index(subject, "#", 1)

    def choose(value) -> Column:  # noqa: ANN001
        return reduce(lambda out, a: out.when(code.isin(*a[0]), value(a)), ACTIONS[1:], F.when(code.isin(*ACTIONS[0][0]), value(ACTIONS[0])))

    def steps(a: tuple) -> Column:
        shown = file if a[1] == "delete-file" else subject
        first = F.struct(F.concat(F.lit(a[6]), shown, F.lit(a[7])).alias("description"), (file if a[5] else F.lit(None).cast("string")).alias("file"), F.lit(a[4]).cast("string").alias("change"))
        more = [F.struct(F.lit(d).alias("description"), F.lit(None).cast("string").alias("file"), F.lit(c).alias("change")) for d, c in [SECOND[a[1]]]] if a[1] in SECOND else []
        return F.array(first, *more).cast(f"array<{_STEP}>")

    none = F.array().cast(f"array<{_STEP}>")
    return found.select(
        F.concat(F.lit("fix-"), F.col("id")).alias("id"), F.col("id").alias("finding_id"), choose(lambda a: F.lit(a[1])).alias("action"), subject.alias("target"),
        choose(lambda a: F.lit(a[2])).alias("phase"), choose(lambda a: F.lit(a[3])).alias("risk"), F.col("confidence"), F.coalesce(choose(steps), none).alias("steps"),
    )
