"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bitpack import op4_token_ids
from .decontaminate import op8_decontaminate
from .gated_lm import op2_gated_lm
from .html_text import op1_html_text
from .language_id import op5_language_id
from .mixing import OP7_SQL, op7_poisson_mix
from .pii import op10_pii
from .simhash import op3_simhash
from .spotsigs import op9_spotsigs, spotsigs_near_classes
from .token_counts import op6_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_gated_lm, op3_simhash, op4_token_ids, op5_language_id, op6_token_counts, op7_poisson_mix, op8_decontaminate, op9_spotsigs, op10_pii)
}
#: A second query of operator 9: its similarity join of the whole collection.
QUERIES["spotsigs_near_classes"] = spotsigs_near_classes
SQL = {"op7_poisson_mix": OP7_SQL}
