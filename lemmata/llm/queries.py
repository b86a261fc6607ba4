"""The queries of this subpackage and, where it can express them, their SQL."""

from __future__ import annotations

from . import companions
from .mixing import SQL as MIXING_SQL
from .mixing import op7_mixing
from .near_dups import SQL as NEAR_SQL
from .near_dups import op1_near_dups
from .neighbours import op9_neighbours
from .packing import op2_packing
from .quality_crf import op8_quality
from .quality_rules import op10_quality_rules
from .secrets import op6_secrets
from .suffix_dedup import SQL as REPEATS_SQL
from .suffix_dedup import op4_repeats
from .toxicity import op5_toxicity
from .url_filters import SQL as URL_SQL
from .url_filters import op3_url_filters

QUERIES = {
    "op1_near_dups": op1_near_dups,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_repeats": op4_repeats,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_quality_rules": op10_quality_rules,
} | companions.QUERIES
#: The others fit models, tokenize or search approximately; they are tested
#: against brute force, round trips and held-out labels, and what SQL can give of
#: their results by the companion queries.
SQL: dict[str, str] = {"op1_near_dups": NEAR_SQL, "op3_url_filters": URL_SQL, "op4_repeats": REPEATS_SQL, "op7_mixing": MIXING_SQL} | companions.SQL
