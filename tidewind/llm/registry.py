"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP3_SQL, op3_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_extraction import op10_html_extraction
from .line_dedup import OP5_SQL, op5_line_dedup
from .near_dedup import OP9_SQL, op9_near_dedup
from .packing import op8_packing
from .phrases import OP12_SQL, op12_phrases
from .pii import op4_pii
from .sentencepieces import op13_sentencepiece
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .toxicity import op1_toxicity
from .warc_archive import OP2_SQL, op2_warc_archive

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_archive": op2_warc_archive,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrases": op12_phrases,
    "op13_sentencepiece": op13_sentencepiece,
}

SQL = {"op2_warc_archive": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_near_dedup": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_phrases": OP12_SQL}
