"""Queries of the corpus operators by name."""

import corpus_pipeline

from .bpe import op3
from .byte_cnn import op9
from .embedding_dedup import op4
from .mixing import op8
from .near_dedup import op1
from .quality_rules import SQL as SQL6
from .quality_rules import op6
from .substring_dedup import op2
from .surrogates import op10
from .toxicity import op7
from .url_filter import op5

QUERIES = {
    "op1_near_dedup": op1,
    "op2_substring_dedup": op2,
    "op3_bpe": op3,
    "op4_embedding_dedup": op4,
    "op5_url_filter": op5,
    "op6_quality_rules": op6,
    "op7_toxicity": op7,
    "op8_mixing": op8,
    "op9_quality_cnn": op9,
    "op10_surrogates": op10,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op6_quality_rules": SQL6} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
