"""What a reviewer of a batch is given: its terms, risks, structure, checks and guide; and judgments of findings as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import bound

# --- fixed values: severities as shown, and for each kind of finding what is said with and without a check's own text ----
SEVERITY_SHOWN = {"critical": "严重", "medium": "中等", "low": "轻微"}
SAID = (  # kinds, text before the check's own text, text without one ({} in turn: source term, expected target, domain, source value)
    (("glossary_violation",), "", '术语 "{source_term}" 术语库要求译为 "{expected_target}"{domain}'),
    (("client_glossary_violation",), "客户术语违规 — ", '客户术语 "{source_term}" 要求译为 "{expected_target}"'),
    (("number_missing", "decimal_mismatch", "temperature_mismatch"), "数字问题 — ", '数字不一致：原文有 "{source_value}"'),
    (("symbol_missing", "cas_missing", "regulation_missing", "punctuation_mixed"), "符号问题 — ", "符号/标点问题"),
    (("full_unit_untranslated",), "单位问题 — ", "单位缩写未翻译"),
    (("format_issue",), "格式问题 — ", "格式不一致"),
)
DOMAIN_SHOWN = "（领域：{}）"
FREQUENT = ("", "frequency", "high_frequency")


def _filled(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern whose {name} parts are columns."""
    parts = [piece for chunk in pattern.split("{") for piece in (chunk.split("}", 1) if "}" in chunk else ("", chunk))]
    return F.concat(*[values[p] if i % 2 == 0 else F.lit(p) for i, p in enumerate(parts) if p])


def judgment(kind: Column, severity: Column, check: Column, source_term: Column, expected_target: Column, domain: Column, source_value: Column) -> Column:
    """A finding as text: its severity, and the check's own text or what its kind says. Of other kinds the check's text.

    Null and unknown severities are medium; a null term, target or check of another kind shows as "?".
    """
    shown = F.lit(SEVERITY_SHOWN["medium"])
    for name, text in SEVERITY_SHOWN.items():
        shown = F.when(severity == name, text).otherwise(shown)
    has_domain = F.coalesce(domain, F.lit("")) != ""
    values = {
        "source_term": F.coalesce(source_term, F.lit("?")), "expected_target": F.coalesce(expected_target, F.lit("?")), "source_value": F.coalesce(source_value, F.lit("")),
        "domain": F.when(has_domain, _filled(DOMAIN_SHOWN.replace("{}", "{d}"), {"d": domain})).otherwise(""),
    }
    has_check, said = F.coalesce(check, F.lit("")) != "", F.coalesce(check, F.lit("?"))
    for kinds, before, without in SAID:
        said = F.when(kind.isin(*kinds), F.when(has_check, F.concat(F.lit(before), check)).otherwise(_filled(without, values))).otherwise(said)
    return F.concat(F.lit("["), shown, F.lit("] "), said)


def checklist(items: list[tuple[str, str, str]], header: str, *more: str) -> str:
    """A checklist as text: a ruled header, a line per (id, name, trigger), and further paragraphs that are not empty."""
    rows = [header, "-" * len(header), "", *(f"  [{i}] {name}: {trigger}" for i, name, trigger in items)]
    return "\n".join(rows + [line for text in more if text for line in ("", text)])


def guide_of(domain: Column, guides: dict[str, str], default: str) -> Column:
    """The translation guide of a domain, the default one where there is none."""
    known = F.create_map(*[F.lit(x) for pair in guides.items() for x in pair]) if guides else None
    return F.lit(default) if known is None else F.coalesce(known[domain], F.lit(default))


def batch_context(paragraphs: DataFrame, terms: DataFrame, high_risk: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per batch: ``(key, batch_id, terms, rare_terms, high_risk, broken, ...)`` with the columns of ``documents``.

    ``paragraphs``: key, batch_id, para_index, text. ``terms``: a document's key terms (source, required_target,
    is_critical, translation_status, importance_reason, count), a bounded list of its own, so they meet its batches by the
    document; those that a batch's text holds in any case come critical ones first, then by count. Rare are those of under
    three occurrences that count for another reason. ``high_risk``: key, para_index, score, reason. ``documents``: key,
    broken (indices of paragraphs without an end) and what is said of the document as a whole, as its domain. Null texts
    count as empty; a batch without terms or risks has empty lists.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_index", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), " ")
    batch = paragraphs.groupBy(key, "batch_id").agg(F.lower(text).alias("_text"), F.sort_array(F.collect_list("para_index")).alias("_at"))
    term = F.struct((~F.col("is_critical")).alias("later"), (-F.col("count")).alias("n"), "source", "required_target", "is_critical", "translation_status", "importance_reason", "count")
    mine = terms.filter("source <> ''").groupBy(key).agg(F.sort_array(F.collect_list(term)).alias("_terms"))
    at = paragraphs.select(key, "para_index", "batch_id")
    risk = high_risk.join(at, [key, "para_index"]).groupBy(key, "batch_id").agg(F.sort_array(F.collect_list(F.struct("para_index", "score", "reason"))).alias("_risk"))
    d = batch.join(mine, key, "left").join(risk, [key, "batch_id"], "left").join(documents, key, "left")
    held = F.transform(F.filter("_terms", lambda t: F.col("_text").contains(F.lower(t["source"]))), lambda t: t.dropFields("later", "n"))
    rare = lambda t: ~t["importance_reason"].isin(*FREQUENT) & (t["count"] < 3)
    empty = lambda c: F.coalesce(c, F.array())
    said = [c for c in documents.columns if c not in (key, "broken")]
    d = d.withColumns({"terms": empty(held), "high_risk": empty(F.col("_risk")), "broken": empty(F.array_intersect("_at", "broken"))})
    return d.select(key, "batch_id", "terms", bound(F.col("terms"), lambda ts: F.filter(ts, rare)).alias("rare_terms"), "high_risk", "broken", *said)
