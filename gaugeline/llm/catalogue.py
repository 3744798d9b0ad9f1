"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .op1_decontaminate import op1_decontaminate
from .op10_html_text import op10_html_text
from .op11_simhash import op11_simhash
from .op12_alignment import op12_alignment
from .op13_prefix_trie import SQL as PREFIX_TRIE_SQL
from .op13_prefix_trie import op13_prefix_trie
from .op2_license_scan import op2_license_scan
from .op3_jaccard import op3_jaccard
from .op4_token_files import op4_token_files
from .op5_nearest import op5_nearest
from .op6_bpe import op6_bpe
from .op7_token_counts import op7_token_counts
from .op8_quality import op8_quality
from .op9_line_dedup import SQL as LINE_DEDUP_SQL
from .op9_line_dedup import op9_line_dedup

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard": op3_jaccard,
    "op4_token_files": op4_token_files,
    "op5_nearest": op5_nearest,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_text": op10_html_text,
    "op11_simhash": op11_simhash,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op9_line_dedup": LINE_DEDUP_SQL,
    "op13_prefix_trie": PREFIX_TRIE_SQL,
}
