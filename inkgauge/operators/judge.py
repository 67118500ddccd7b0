"""Findings and scores from judge answers that arrive as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators.findings import finding, rows_of

AXIS = "struct<name:string,score:double,worst_sentence:string,suggested_rewrite:string,reason:string>"


def parse_answers(answers: DataFrame) -> DataFrame:
    """``axes``: NULL when the answer holds no readable JSON object."""
    parsed = F.try_variant_get(
        F.try_parse_json(X.extract_json_object(F.col("answer"))), "$.axes", "array<variant>"
    )
    axes = F.transform(
        parsed,
        lambda a: F.struct(
            *[
                F.try_variant_get(a, f"$.{name}", kind).alias(name)
                for name, kind in (
                    ("name", "string"), ("score", "double"), ("worst_sentence", "string"),
                    ("suggested_rewrite", "string"), ("reason", "string"),
                )
            ]
        ),
    )
    return answers.withColumn("axes", axes)


def axis_findings(layer: str) -> Column:
    """Findings of one judge's ``axes``; ``layer`` is humanization or quality."""
    human = layer == "humanization"

    def check(a: Column) -> Column:
        slug = F.lower(F.regexp_replace(a["name"], X.WS + "+", "_"))
        check_id = F.concat(F.lit("H_judge_"), slug) if human else F.concat(F.lit("Q_"), a["name"])
        kind = F.lit("replace_span") if human else F.when(a["name"] == "intro_hook", "rewrite_intro").otherwise("replace_span")
        shown = F.concat(X.number_text(a["score"]), F.lit("/10"))
        patch = F.when(
            (a["worst_sentence"] != "") & (a["suggested_rewrite"] != ""),
            F.struct(
                kind.alias("type"), a["worst_sentence"].alias("target"), a["worst_sentence"].alias("before"),
                a["suggested_rewrite"].alias("after"),
                F.concat(F.lit('Axis "'), a["name"], F.lit('" scored '), shown, F.lit(": "), a["reason"]).alias("rationale"),
            ),
        )
        return finding(
            check_id, layer, F.when(a["score"] <= 3, "fail").otherwise("warn"), "model",
            F.concat(a["name"], F.lit(" "), shown, F.lit(" — "), a["reason"]), a["score"] < 7, patch=patch,
        )

    unreadable = finding(
        "H_judge_parse_error" if human else "Q_parse_error", layer, "info", "model", "the judge's answer cannot be read"
    )
    return F.when(F.col("axes").isNull(), F.array(unreadable)).otherwise(
        F.array_compact(F.transform("axes", check))
    )


def axis_score() -> Column:
    """Ten times the mean axis score, kept in 0..100; the neutral score when unreadable."""
    total = F.aggregate("axes", F.lit(0.0), lambda acc, a: acc + a["score"])
    mean = total / F.greatest(F.size("axes"), F.lit(1))
    return (
        F.when(F.col("axes").isNull(), F.lit(dims.UNJUDGED_QUALITY))
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), X.round_half_up(mean * 10))))
        .cast("int")
    )


def judge_rows(answers: DataFrame, layer: str, key: str = "doc_id") -> DataFrame:
    """Findings of one judge as a long table."""
    return rows_of(parse_answers(answers), [key], axis_findings(layer), "ord", "f").select(key, "ord", "f.*")
