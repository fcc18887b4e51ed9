"""Queries of this subpackage, with the SQL that each must agree with where SQL can say it."""

from tarnflow.llm.chat_formatting import ORACLE_OP8, op8_chat_formatting
from tarnflow.llm.decontamination import ORACLE_OP4, op4_decontamination
from tarnflow.llm.embedding_dedup import ORACLE_OP1, op1_embedding_near_dedup
from tarnflow.llm.html_extraction import op2_html_extraction
from tarnflow.llm.jaccard_join import ORACLE_OP6, op6_ngram_jaccard_join
from tarnflow.llm.line_dedup import ORACLE_OP9, op9_line_dedup
from tarnflow.llm.source_mixing import ORACLE_OP10, op10_source_mixing
from tarnflow.llm.suffix_dedup import op5_suffix_array_dedup
from tarnflow.llm.toxicity import op7_toxicity
from tarnflow.llm.url_filter import ORACLE_OP3, op3_url_filter

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
}
ORACLE_SQL = {
    "op1_embedding_near_dedup": ORACLE_OP1,
    "op3_url_filter": ORACLE_OP3,
    "op4_decontamination": ORACLE_OP4,
    "op6_ngram_jaccard_join": ORACLE_OP6,
    "op8_chat_formatting": ORACLE_OP8,
    "op9_line_dedup": ORACLE_OP9,
    "op10_source_mixing": ORACLE_OP10,
}
