"""Queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from corpusforge.llm import line_dedup
from corpusforge.llm.compress_quality import op8_quality_classifier
from corpusforge.llm.decontaminate import op4_decontaminate
from corpusforge.llm.license_scan import op6_license_scan
from corpusforge.llm.line_dedup import op10_line_dedup
from corpusforge.llm.lm_score import op2_lm_score
from corpusforge.llm.mixing import op7_mixing
from corpusforge.llm.quality_rules import op5_quality_rules
from corpusforge.llm.secret_scan import op3_secret_scan
from corpusforge.llm.simhash import op9_simhash
from corpusforge.llm.url_filter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_lm_score,
        op3_secret_scan,
        op4_decontaminate,
        op5_quality_rules,
        op6_license_scan,
        op7_mixing,
        op8_quality_classifier,
        op9_simhash,
        op10_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op10_line_dedup": line_dedup.ORACLE}
