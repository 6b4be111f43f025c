"""Queries of this subpackage and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import leakage, mixing, percentiles, proportions, visual


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Target categories that capture_metadata cannot supply."""
    _, cells, _ = proportions.plan(_t(spark, d, "capture_metadata"), _t(spark, d, "category_targets"))
    return cells.where("is_short").select("label_class", "modcod")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample itself: one row per drawn idx."""
    one, cells, _ = proportions.plan(_t(spark, d, "capture_metadata"), _t(spark, d, "category_targets"))
    return proportions.draw(one, cells)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Quotas, availability and shortfalls of all target categories."""
    _, cells, _ = proportions.plan(_t(spark, d, "capture_metadata"), _t(spark, d, "category_targets"))
    return cells


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles that left their reference."""
    return percentiles.drifted(_t(spark, d, "signal_metadata"), _t(spark, d, "label_reference"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per label class and field for each day, and for days combined (capture_day null)."""
    values = percentiles.signal_values(_t(spark, d, "signal_metadata"))
    return percentiles.two_tailed(values, ["label_class", "capture_day", "field_name"], ["label_class", "field_name"], [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0, 99.9])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry at least half of an evaluation item."""
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that leaked: in how many documents, and the largest share found."""
    found = leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.max("share_found"), 6).alias("most_found"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their target weight."""
    _, report = mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_targets"))
    return report.where("is_short").select("source")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Targets and actual shares of the sources."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but are stored differently."""
    return visual.look_pairs(_t(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with the class of documents that look the same."""
    return visual.look_classes(_t(spark, d, "documents"))


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its text in the one form."""
    return visual.one_form(_t(spark, d, "documents").select("doc_id", "text"), "text", "text_form").select("doc_id", "text_form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_sample, p1_report, p4_found, p4_percentiles, p6_found, p6_items, p7_found, p7_copies, p7_report, p8_found, p8_classes, p8_text)
    return {f.__name__: f for f in names}


CELLS = """
WITH one AS (SELECT DISTINCT idx, lower(trim(label)) AS label_class, modcod FROM capture_metadata WHERE idx IS NOT NULL),
     s AS (SELECT count(DISTINCT idx) // 5 AS n FROM one),
     have AS (SELECT label_class, modcod, count(DISTINCT idx) AS available FROM one GROUP BY ALL)
SELECT t.label_class, t.modcod, t.target_share, t.min_rows, coalesce(h.available, 0) AS available,
       greatest(t.min_rows::DOUBLE, t.target_share * s.n) AS wanted
FROM category_targets t CROSS JOIN s LEFT JOIN have h ON h.label_class = lower(trim(t.label_class)) AND h.modcod = t.modcod
"""

VALUES = """
WITH one AS (SELECT signal_id, arg_min(lower(trim(label)), written_at) AS label_class, arg_min(captured_at, written_at) AS captured_at,
                    arg_min(struct_pack(bandwidth := bandwidth, center_freq := center_freq), written_at) AS v
             FROM signal_metadata GROUP BY signal_id),
     v AS (SELECT label_class, strftime(captured_at, '%Y-%m-%d') AS capture_day, 'bandwidth' AS field_name, v.bandwidth AS x FROM one
           UNION ALL SELECT label_class, strftime(captured_at, '%Y-%m-%d'), 'center_freq', v.center_freq FROM one),
     g AS (SELECT label_class, capture_day, field_name, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.95) AS p95
           FROM v WHERE isfinite(x) GROUP BY ALL HAVING count(*) >= 40),
     l AS (SELECT label_class, capture_day, field_name, 50::BIGINT AS pct, p50 AS x FROM g
           UNION ALL SELECT label_class, capture_day, field_name, 95::BIGINT, p95 FROM g)
SELECT l.label_class, l.capture_day, l.field_name, l.pct
FROM l JOIN label_reference r USING (label_class, field_name)
WHERE abs(l.x - CASE l.pct WHEN 50 THEN r.ref_p50 ELSE r.ref_p95 END) > 0.25 * r.ref_spread
"""


# No case depends on the tokenizer, so code points do for tokens.
SHORT = """
WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS n FROM documents WHERE length(text) > 0),
     t AS (SELECT lower(trim(source)) AS source, target_weight, max_repeats, coalesce((SELECT sum(n) FROM d WHERE d.source = lower(trim(t.source))), 0) AS n FROM source_targets t)
SELECT source FROM t WHERE max_repeats * n < target_weight * (SELECT sum(n) FROM t)
"""


# What the published confusables add to visual.LOOK_ALIKE in the blocks of Greek and Cyrillic.
PUBLISHED = {"α": "a", "γ": "y", "ι": "i", "ρ": "p", "υ": "u", "Ϝ": "F", "Ь": "b", "г": "r"}


def _wider() -> dict[str, str]:
    """These, and the Greek and Cyrillic letters that are a look-alike with accents, as the Latin letter with the same accents."""
    out = dict(PUBLISHED)
    for ch in map(chr, range(0x370, 0x530)):
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and len(r := unicodedata.normalize("NFC", (visual.LOOK_ALIKE | PUBLISHED).get(d[0], d[0]) + d[1:])) == 1:
            out[ch] = r
    return out


def _form_sql(more: dict[str, str] | None = None) -> str:
    """f(doc_id, text, look) by nfc_normalize() and translate(), which takes accented look-alikes of the Greek and Cyrillic blocks one by one."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    single = {k: v for k, v in visual.LOOK_ALIKE.items() if len(v) == 1} | (more or {})
    blanks = "      　"
    a = wide + "".join(single) + blanks + "µΩK"
    b = plain + "".join(single.values()) + " " * len(blanks) + "μΩK"
    q = lambda s: s.replace("'", "''")
    return f"""
WITH f AS (SELECT doc_id, text, nfc_normalize(translate(nfc_normalize(regexp_replace(text, '\\p{{Cf}}', '', 'g')), '{q(a)}', '{q(b)}')) AS look
           FROM documents WHERE text IS NOT NULL)"""


def _look_sql() -> str:
    return f"""{_form_sql()}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id WHERE a.text <> b.text
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT label_class, modcod FROM ({CELLS}) WHERE available < wanted",
        "p4_found": VALUES,
        "p7_found": SHORT,
        "p8_text": f"{_form_sql(_wider())} SELECT d.doc_id, f.look AS text_form FROM documents d LEFT JOIN f USING (doc_id)",
        "p8_classes": f"{_form_sql()} SELECT doc_id, min(doc_id) OVER w AS look_class, count(*) OVER w AS n_same_look, n_stored_forms FROM f JOIN (SELECT look, count(DISTINCT text) AS n_stored_forms FROM f GROUP BY look) USING (look) WINDOW w AS (PARTITION BY look)",
        "p8_found": _look_sql(),
    }
