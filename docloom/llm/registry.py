"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from docloom.llm.ann import op2_nearest
from docloom.llm.bpe import op1_byte_bpe
from docloom.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from docloom.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from docloom.llm.language_id import op8_language_id
from docloom.llm.packing import op5_packing
from docloom.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from docloom.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from docloom.llm.url_filter import OP9_SQL, op9_url_filter
from docloom.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_nearest": op2_nearest,
    "op3_warc": op3_warc,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {
    "op3_warc": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
