"""Weighted rule scoring of transactions as one Catalyst projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from txrisk.constants import REASONS_TYPE, SEVERITY_FACTORS
from txrisk.functions.columns import holds

NO_REASON = "no rule applies"
CUT = 0.5


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    weight: float
    text: str  # may name {amount} and {share}, the percentage of the balance
    condition: str  # Spark SQL over the transaction columns and ``_ratio``


# ---------------------------------------------------------------- fixed values
# Rules in the order in which their weights are added.
RULES = [
    Rule("R1", "high", 0.8, "needs {amount} but holds less", "amount > oldbalanceOrg AND oldbalanceOrg > 0"),
    Rule("R2", "high", 0.7, "under 5 % of the opening balance is left",
         "oldbalanceOrg > 0 AND newbalanceOrig < oldbalanceOrg * 0.05D AND type IN ('TRANSFER', 'CASH_OUT')"),
    Rule("R3a", "high", 0.6, "share sent: {share} % (limit 80)", "_ratio > 0.8D AND type IN ('TRANSFER', 'CASH_OUT')"),
    Rule("R3b", "medium", 0.4, "share sent: {share} % (limit 50)",
         "_ratio > 0.5D AND _ratio <= 0.8D AND type IN ('TRANSFER', 'CASH_OUT')"),
    Rule("R4a", "medium", 0.5, "value {amount}, limit 10000", "amount > 10000"),
    Rule("R4b", "low", 0.3, "value {amount}, limit 5000", "amount > 5000 AND amount <= 10000"),
    Rule("R5", "medium", 0.5, "payee of a TRANSFER has a merchant number", "type = 'TRANSFER' AND startswith(nameDest, 'M')"),
    Rule("R6", "medium", 0.5, "closing balance 0 after paying {amount}", "newbalanceOrig = 0 AND amount > 0 AND oldbalanceOrg > 0"),
    Rule("R7", "medium", 0.4, "TRANSFER above 1000 closes at 0: {amount}",
         "type = 'TRANSFER' AND amount > 1000 AND newbalanceOrig = 0"),
    Rule("R8", "low", 0.3, "CASH_OUT takes {share} % (limit 50)", "type = 'CASH_OUT' AND _ratio > 0.5D"),
    Rule("R9a", "medium", 0.4, "value is a listed one: {amount}", "amount IN (9999D, 10000D, 5000D)"),
    Rule("R9b", "low", 0.3, "last four digits of {amount} are 0000, 5000 or 9999",
         "amount > 1000 AND amount % 1 = 0 AND amount % 10000 IN (0D, 9999D, 5000D) "
         "AND amount NOT IN (9999D, 10000D, 5000D)"),
]
# ----------------------------------------------------------- end fixed values

BALANCE_RATIO = "CASE WHEN oldbalanceOrg > 0 THEN amount / (oldbalanceOrg + 1) ELSE amount END"

# Figures in texts, cut to whole numbers.
FIGURES = {"amount": "floor(amount)", "share": f"floor(100 * ({BALANCE_RATIO}))"}


def with_figures(line: str) -> Column:
    """A line of texts, as Spark SQL, with the row's figures put in."""
    for name, figure in FIGURES.items():
        line = f"replace({line}, '{{{name}}}', coalesce(cast({figure} AS string), ''))"
    return F.expr(line)


def _weighted(factor) -> str:
    """Sum over the rules that hold, in rule order: sums of doubles depend on the
    order, and many rows lie exactly on the cut."""
    return " + ".join(f"CASE WHEN {rule.code} THEN {factor(rule)!r}D ELSE 0D END" for rule in RULES)


def rule_flags(df: DataFrame) -> DataFrame:
    """Add one boolean column per rule, named after its code."""
    flags = {rule.code: F.expr(f"coalesce({rule.condition}, false)") for rule in RULES}
    return df.withColumn("_ratio", F.expr(BALANCE_RATIO)).withColumns(flags).drop("_ratio")


def raw_score() -> Column:
    """Weights of the rules that hold."""
    return F.expr(_weighted(lambda rule: rule.weight))


def flagged_weight() -> Column:
    """Severity-weighted evidence straight from the flags; equal to
    ``false_positives.reason_weight`` on the reasons of the same row."""
    return F.expr(f"least(({_weighted(lambda rule: rule.weight * SEVERITY_FACTORS[rule.severity])}) / 2D, 1D)")


def reasons() -> Column:
    """Array of the rules that hold, in rule order. Joined from arrays of one
    entry or none, which stays in generated code."""
    none = f"cast(array() AS {REASONS_TYPE})"
    entries = [
        f"CASE WHEN {r.code} THEN array(named_struct('code', '{r.code}', 'severity', '{r.severity}', "
        f"'weight', {r.weight!r}D)) ELSE {none} END"
        for r in RULES
    ]
    return F.expr(f"concat({', '.join(entries)})")


def flagged_count() -> Column:
    return F.expr(" + ".join(f"cast({rule.code} AS int)" for rule in RULES))


def flagged_text() -> Column:
    """Texts of the rules that hold in one line, or a word that there are none."""
    joined = ", ".join(f"CASE WHEN {rule.code} THEN '{rule.text}' END" for rule in RULES)
    return with_figures(f"coalesce(nullif(concat_ws(' | ', {joined}), ''), '{NO_REASON}')")


def confidence(score: str) -> Column:
    return F.expr(f"CASE WHEN {score} > 0.7D THEN 'high' WHEN {score} > 0.4D THEN 'medium' ELSE 'low' END")


def rule_score(df: DataFrame) -> DataFrame:
    """Add raw_score, score, confidence, is_fraud, reasons, and what later steps
    need of the reasons: weighted_score, n_reasons and fraud_reasons (text).
    Columns that a caller does not use are never computed."""
    extra = {
        "raw_score": raw_score(), "reasons": reasons(), "weighted_score": flagged_weight(),
        "n_reasons": flagged_count(), "fraud_reasons": flagged_text(),
    }
    scored = rule_flags(df).withColumns(extra).drop(*[rule.code for rule in RULES])
    return scored.withColumn("score", F.expr("1D / (1D + exp(-10D * (raw_score - 0.5D)))")).withColumns({
        "confidence": confidence("score"), "is_fraud": F.expr(f"score > {CUT}D"),
    })


def reason_codes(column: str = "reasons") -> Column:
    return F.array_join(F.transform(column, lambda r: r["code"]), " ")


def reason_text(column: str = "reasons") -> Column:
    """Text of an array of reasons that did not come from these rules' flags; the row's amount and balance give the figures."""
    texts = "map(" + ", ".join(f"'{rule.code}', '{rule.text}'" for rule in RULES) + ")"
    joined = with_figures(f"array_join(transform({column}, r -> {texts}[r.code]), ' | ')")
    return F.when(F.size(column) == 0, NO_REASON).otherwise(joined)


def fallback_rule() -> Column:
    """Verdict (0/1) used when no model is available."""
    return F.expr("""
        CASE WHEN amount > 5000000 OR (amount > 1000000 AND oldbalanceOrg > 0 AND newbalanceOrig = 0
                                       AND type IN ('TRANSFER', 'CASH_OUT'))
        THEN 1 ELSE 0 END""")


def risk_score(probability: Column, fast: Column, odd_hour: Column, customer_risk: Column) -> Column:
    """Probability raised by the state of the customer, kept within 0..1."""
    def raised(score: Column, when: Column, by: float) -> Column:
        return F.when(holds(when), F.least(F.lit(1.0), score + F.lit(by))).otherwise(score)

    score = raised(probability, fast != 0, 0.1)
    score = raised(score, odd_hour != 0, 0.05)
    score = raised(score, customer_risk > 0.7, 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
