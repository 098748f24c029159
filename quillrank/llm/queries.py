"""Query registry of this subpackage: name to callable, and name to SQL where SQL can say it."""

from __future__ import annotations

from . import (
    chat,
    decontaminate,
    html_template,
    licenses,
    line_dedup,
    mixing,
    mtree,
    quality_rules,
    simhash,
    url_rules,
)

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_html_extract": html_template.op2_html_extract,
    "op3_url_filter": url_rules.op3_url_filter,
    "op4_mtree_topk": mtree.op4_mtree_topk,
    "op5_mix": mixing.op5_mix,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_classifier": quality_rules.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}

SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_url_filter": url_rules.OP3_SQL,
    "op4_mtree_topk": mtree.OP4_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
