"""The whole plan of a run: score, match lists, look facts up, and shape the result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.suffix import SuffixRules
from lynceus.operators.enrich import enrich
from lynceus.operators.lists import UserLists, match_lists
from lynceus.operators.scoring import MODES, OUTPUT, ModelDocument, fixed3, guarded, score_urls


def analyse(
    df: DataFrame, model: ModelDocument, column: str = "url", lists: UserLists | None = None, base_rate: float | None = None, rules: SuffixRules | None = None,
    second: ModelDocument | None = None, dns: DataFrame | None = None, rdap: DataFrame | None = None, now: float = 0.0, mode: str = "off",
    look_up: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Typed results: df with p, model_verdict, model_probability, fraud_verdict, confidence, reasons, list_kind, list_entry, analysis_mode and more.

    A list decides over the model, but never over an ERROR. mode is off, review or all. Facts for the second pass are in dns and rdap,
    or look_up gives both tables for the rows of the first pass, which is kept meanwhile.
    """
    out = score_urls(df, model, column, base_rate, rules)
    if lists is not None:
        out = match_lists(out, lists.entries)
        valid = F.col("error").isNull()
        out = out.withColumns({"list_kind": F.when(valid, F.col("list_kind")), "list_entry": F.when(valid, F.col("list_entry"))})
    else:
        out = out.withColumns({"list_kind": F.lit(None).cast("string"), "list_entry": F.lit(None).cast("string")})
    out = out.withColumns({"offline_verdict": F.col("fraud_verdict"), "offline_probability": F.col("adjusted")})
    if mode != "off":
        if look_up is not None and dns is None and rdap is None:
            out = out.persist()
            dns, rdap = look_up(out)
        if second is None or dns is None or rdap is None:
            raise ValueError("look-ups need the second model and both tables of facts")
        out = enrich(out, model, second, dns, rdap, now, mode, column, base_rate)
    else:
        by_list = F.concat(F.lit("your "), F.col("list_kind"), F.lit(" list"))
        out = out.withColumns({"analysis_mode": F.coalesce(by_list, F.lit(MODES["offline"])), "lookup_status": F.lit("")})
    out = out.withColumns({"model_verdict": F.col("fraud_verdict"), "model_probability": F.col("adjusted")})
    # As texts in a projection of their own: several cells of the results show them.
    out = out.withColumns({"probability_text": fixed3(F.col("model_probability")), "confidence_text": fixed3(F.col("confidence")), "offline_text": fixed3(F.col("offline_probability"))})
    return out.withColumn("fraud_verdict", F.when(F.col("list_kind") == "block", "FRAUD").when(F.col("list_kind") == "allow", "LEGITIMATE").otherwise(F.col("fraud_verdict")))


def result_cells(out: DataFrame) -> dict[str, Column]:
    """The eight result columns as text, as they go to CSV."""
    listed = F.col("list_kind").isNotNull()
    probability = F.col("probability_text")
    alone = F.concat(F.col("model_verdict"), F.when(probability != "", F.concat(F.lit(" ("), probability, F.lit(")"))).otherwise(""))
    by_list = F.concat(F.lit("on your "), F.col("list_kind"), F.lit(" list (entry '"), F.col("list_entry"), F.lit("'); the model alone said "), alone)
    cells = {
        "fraud_verdict": F.col("fraud_verdict"), "fraud_probability": F.when(listed, "").otherwise(probability), "verdict_confidence": F.when(listed, "").otherwise(F.col("confidence_text")),
        "top_reasons": F.when(listed, by_list).otherwise(F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), "; ")), "registrable_domain": F.col("registrable_domain"),
        "analysis_mode": F.col("analysis_mode"), "lookup_status": F.col("lookup_status"), "error": F.col("error"),
    }
    return {k: guarded(cells[k]) for k in OUTPUT}


def json_records(out: DataFrame, url: str, keys: dict[str, str] | None = None) -> Column:
    """A JSON text per row: the results with numbers and nulls, the stages they came from, and the input's cells by key."""
    listed = F.col("list_kind").isNotNull()
    number = lambda text: F.nullif(F.col(text), F.lit("")).cast("double")
    filled = lambda c: F.nullif(c, F.lit(""))
    cells = result_cells(out)
    offline_v = F.when(listed, F.col("model_verdict")).otherwise(F.col("offline_verdict"))
    offline_p = F.when(listed, number("probability_text")).otherwise(number("offline_text"))
    stages = {"offline_check": F.to_json(F.struct(offline_v.alias("verdict"), offline_p.alias("probability")), {"ignoreNullFields": "false"})}
    stages["your_list"] = F.when(listed, F.to_json(F.struct(F.col("list_kind").alias("list"), F.col("fraud_verdict").alias("decision"))))
    if "evidence" in out.columns:
        stages["lookups"] = F.to_json("evidence", {"ignoreNullFields": "false"})
    staged = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in stages.items()]), F.lit("}"))
    reasons = F.when(listed, F.array(cells["top_reasons"])).otherwise(F.coalesce("reasons", F.array().cast("array<string>")))
    main = F.struct(
        F.col(f"`{url}`").alias("url"), F.col("fraud_verdict"), F.when(~listed, number("probability_text")).alias("fraud_probability"), F.when(~listed, number("confidence_text")).alias("verdict_confidence"),
        reasons.alias("top_reasons"), filled(F.col("registrable_domain")).alias("registrable_domain"), F.col("analysis_mode"), filled(F.col("lookup_status")).alias("lookup_status"), filled(F.col("error")).alias("error"),
    )
    text = F.to_json(main, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    parts = [F.substring(text, F.lit(1), F.length(text) - 1), F.concat(F.lit('"stages":'), staged)]
    if keys:
        echo = F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for c, k in keys.items()])
        parts.append(F.concat(F.lit('"input":'), F.to_json(echo, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})))
    return F.concat(F.concat_ws(",", *parts), F.lit("}"))
