"""Registered queries of the subpackage, and SQL for those that it can express."""

from __future__ import annotations

from .embedding_dedup import op10_embedding_dedup
from .html_text import op12_html
from .lm_scoring import op6_lm_scoring
from .manifest import SQL as MANIFEST_SQL, op11_manifest
from .mixing import SQL as MIXING_SQL, op4_mixing
from .packing import op3_packing
from .periodic import op13_periodic
from .quality import op1_quality
from .secrets import op9_secrets
from .simhash import op5_simhash
from .suffix_dedup import op2_suffix_dedup
from .chaining import op7_chaining
from .warc import SQL as WARC_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_suffix_dedup, op3_packing, op4_mixing, op5_simhash, op6_lm_scoring, op7_chaining, op8_warc, op9_secrets, op10_embedding_dedup, op11_manifest, op12_html, op13_periodic)
}
ORACLES = {"op4_mixing": MIXING_SQL, "op8_warc": WARC_SQL, "op11_manifest": MANIFEST_SQL}
