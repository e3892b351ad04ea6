"""Days-early labels of the training listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.sources.files import decode_missing

SAME_DAY_LABEL = 31
OVERDUE_LABEL = 32
NUM_CLASSES = 33


@dataclass(frozen=True)
class LabelRule:
    """How missing repayments, same-day repayments and zero amounts are labelled."""

    missing_after_due: int
    same_day: int | None
    zero_amount: int | None


LABEL_RULES = {
    "canonical": LabelRule(1, SAME_DAY_LABEL, OVERDUE_LABEL),
    "integration": LabelRule(0, None, OVERDUE_LABEL),
    "feature_only": LabelRule(1, SAME_DAY_LABEL, None),
    "exploration": LabelRule(1, OVERDUE_LABEL, None),
}


def with_label(train: DataFrame, rule: str = "canonical", name: str = "label") -> DataFrame:
    """Decode ``repay_date`` and ``repay_amt`` and add the label column.

    The label is the number of days repaid before the due date; the zero-amount
    rule wins over the same-day rule.
    """
    spec = LABEL_RULES[rule]
    decoded = train.withColumns(
        {
            "repay_date": decode_missing(
                "repay_date", "date", F.date_add("due_date", spec.missing_after_due)
            ),
            "repay_amt": decode_missing("repay_amt", "double", F.lit(0.0)),
        }
    )
    label = F.datediff("due_date", "repay_date")
    if spec.same_day is not None:
        label = F.when(F.col("auditing_date") == F.col("repay_date"), spec.same_day).otherwise(label)
    if spec.zero_amount is not None:
        label = F.when(F.col("repay_amt") == 0, spec.zero_amount).otherwise(label)
    return decoded.withColumn(name, label)
