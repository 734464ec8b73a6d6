"""Language routing: evidence columns, verdicts, the heuristic gate, reasons, and manual decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.text import cjk_ratio, marker_score, nonsense_ratio, script_ratio

# Words of spoken Cantonese and Mandarin, and characters of one script alone.
CANTONESE = ("係", "唔", "咗", "喺", "嘅", "冇", "佢", "嗰", "嚟", "乜", "點", "畀", "攞", "啲", "噉")
MANDARIN = ("吗", "嗎", "们", "們", "什么", "什麼", "怎么", "怎麼", "哪儿", "哪兒", "干嘛", "幹嘛", "咱")
SIMPLIFIED = "们这说对吗么没车东学给语读见谓语让证"
TRADITIONAL = "們這說對嗎麼沒車東學給語讀見謂語讓證"

ROUTES = ("cantonese", "mandarin", "european", "uncertain")
CHINESE_CJK, NONSENSE, CONFIDENT = 0.25, 0.5, 0.8
#: The gate's defaults.
WINDOWS, GATE_CJK, GATE_SCORE, DOMINANCE, OPPOSING = 2, 0.6, 4.0, 3.0, 0.5


def evidence(texts: DataFrame, cantonese: tuple[str, ...] = CANTONESE, mandarin: tuple[str, ...] = MANDARIN) -> DataFrame:
    """texts (hk_text, cn_text, eu_text, other columns) with evidence columns, rounded before anything compares them.

    zh_cjk is that of the Cantonese candidate; scores are hits for each hundred visible characters.
    """
    hk, cn, eu = F.col("hk_text"), F.col("cn_text"), F.col("eu_text")
    return texts.withColumns({
        "zh_cjk": F.round(cjk_ratio(hk), 3), "eu_cjk": F.round(cjk_ratio(eu), 3), "nonsense": F.round(nonsense_ratio(eu), 3),
        "hk_cantonese": F.round(marker_score(hk, cantonese), 2), "hk_mandarin": F.round(marker_score(hk, mandarin), 2),
        "cn_cantonese": F.round(marker_score(cn, cantonese), 2), "cn_mandarin": F.round(marker_score(cn, mandarin), 2),
        "hk_trad": F.round(script_ratio(hk, TRADITIONAL, SIMPLIFIED), 3), "cn_trad": F.round(script_ratio(cn, TRADITIONAL, SIMPLIFIED), 3),
    })


def verdict() -> Column:
    """cantonese or mandarin where one outweighs the other twice, else uncertain."""
    hk = F.col("hk_cantonese") + 0.1 * F.col("hk_trad")
    cn = F.col("cn_mandarin") + 0.1 * (1 - F.col("cn_trad"))
    floor = F.lit(0.001)
    return F.when((hk <= 0) & (cn <= 0), "uncertain").when(hk >= 2 * F.greatest(cn, floor), "cantonese").when(cn >= 2 * F.greatest(hk, floor), "mandarin").otherwise("uncertain")


def family() -> Column:
    zh, eu = F.col("zh_cjk") >= CHINESE_CJK, F.col("eu_cjk") < CHINESE_CJK
    return F.when(zh & eu, "chinese").when(eu & (F.col("nonsense") < NONSENSE), "european").when(zh, "chinese").otherwise("uncertain")


def gate(windows: Column, loud: Column, least: float = GATE_SCORE) -> Column:
    """cantonese or mandarin, if all checks hold for exactly one of them, else null.

    Needs the family and verdict columns. windows and loud: how many windows were heard, and how many were
    not silent. The opposing score is the greatest one of the other language and of the same words in
    the other candidate.
    """
    sure = (F.col("family") == "chinese") & (windows >= WINDOWS) & (loud >= WINDOWS) & (F.col("zh_cjk") >= GATE_CJK)

    def passes(name: str, target: Column, *others: Column) -> Column:
        against = F.greatest(*others)
        return sure & (F.col("verdict") == name) & (target >= least) & (target >= DOMINANCE * F.greatest(against, F.lit(0.01))) & (against <= OPPOSING)

    hk = passes("cantonese", F.col("hk_cantonese"), F.col("hk_mandarin"), F.col("cn_mandarin"))
    cn = passes("mandarin", F.col("cn_mandarin"), F.col("hk_cantonese"), F.col("cn_cantonese"))
    return F.when(hk & ~cn, "cantonese").when(cn & ~hk, "mandarin")


def classify(texts: DataFrame, classifier: Callable[[list[str]], list[tuple[str | None, float | None]]], batch: int = 64) -> DataFrame:
    """texts (key, sample) with the route and confidence that a caller's function gives, in batches; null where it gives none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                said = classifier(list(part["sample"]))
                yield pd.DataFrame({"key": part["key"], "classifier": [s[0] for s in said], "confidence": [s[1] for s in said]})

    return texts.select(F.col("key").cast("long").alias("key"), "sample").mapInPandas(run, "key long, classifier string, confidence double")


def route(confident: float = CONFIDENT) -> tuple[Column, Column]:
    """(reason, route) of the automatic decision, in the order of the checks.

    Columns: enabled, sampling (null, too_short or failed), silent, complete (all candidates are there), family,
    verdict, gate, classifier (a route of ROUTES; null: unavailable; anything else: invalid), confidence.
    The classifier's own route is what is suggested. It contradicts the evidence only if both name a family; a
    Chinese route that the verdict does not share stays, as zh_ambiguous.
    """
    said = F.col("classifier")
    chinese = said.isin("cantonese", "mandarin")
    known = said.isin(*ROUTES)
    sure = (F.col("family") != "uncertain") & (said != "uncertain")
    failed = F.when(F.col("classifier").isNull(), "unavailable").otherwise("invalid")
    reason = (
        F.when(~F.col("enabled"), "routing_disabled").when(F.col("sampling") == "too_short", "too_short").when(F.col("sampling").isNotNull(), "sampling_failed")
        .when(F.col("silent"), "silent").when(~F.col("complete"), "candidates_disagree")
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.when(F.col("gate").isNotNull(), "auto_confident_heuristic_").otherwise("classifier_"), failed))
        .when(sure & (F.when(chinese, "chinese").otherwise("european") != F.col("family")), "contradictory_evidence").when(chinese & (F.col("verdict") != said), "zh_ambiguous")
        .when((said != "uncertain") & (F.col("confidence") >= confident), "auto_confident").otherwise("low_confidence")
    )
    taken = (
        F.when(F.col("reason").isin("auto_confident", "low_confidence", "zh_ambiguous"), said)
        .when(F.startswith("reason", F.lit("auto_confident_heuristic")), F.col("gate")).otherwise("uncertain")
    )
    return reason, taken


def routed(rows: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """rows of evidence() with candidate texts' windows, loud and the inputs of route(): family, verdict, gate, reason and route."""
    rows = rows.withColumns({"family": family(), "verdict": verdict()}).withColumn("gate", gate(F.col("windows"), F.col("loud")))
    reason, taken = route(confident)
    return rows.withColumn("reason", reason).withColumn("route", taken)


def manual_routes(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """recording_id, result, route and new status of requests (recording_id, route) for a manual route.

    decisions: one active row a recording at most (recording_id, route, processing_status, failure_stage,
    archived_at). The same route again only confirms; another one on a transcribed recording sends it back
    to be transcribed; archived, running and otherwise failed recordings refuse.
    """
    status = F.col("processing_status")
    may = status.isin("routing", "needs_review", "ready_to_transcribe", "transcribed") | (status == "failed") & (F.col("failure_stage") == "routing")
    rows = requests.select("recording_id", F.col("route").alias("wanted")).join(decisions, "recording_id", "left")
    result = (
        F.when(status.isNull(), "not_found").when(F.col("archived_at").isNotNull(), "refused_archived").when(~F.coalesce(may, F.lit(False)), "refused_status")
        .when(F.col("route").eqNullSafe(F.col("wanted")), "confirmed").otherwise("appended")
    )
    rows = rows.withColumn("result", result)
    after = F.when(F.col("result") == "appended", "ready_to_transcribe").when((F.col("result") == "confirmed") & (status != "transcribed"), "ready_to_transcribe").otherwise(status)
    return rows.select("recording_id", "result", F.when(F.col("result").isin("confirmed", "appended"), F.col("wanted")).otherwise(F.col("route")).alias("route"), after.alias("status"))


def effective_routes(decisions: DataFrame) -> DataFrame:
    """The decision that counts of each recording's append-only log (recording_id, ordinal, method, route): the newest manual one, else the newest."""
    order = Window.partitionBy("recording_id").orderBy(F.when(F.col("method") == "manual", 0).otherwise(1), F.desc("ordinal"))
    return decisions.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at")
