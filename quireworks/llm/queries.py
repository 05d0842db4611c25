"""The queries of this subpackage and, where SQL can express one, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers

from .bpe import round_trip
from .chat_format import CHAT_SQL, perspective_rows
from .common import table
from .exact_dedup import EXACT_SQL, exact_groups
from .html_extract import main_texts
from .language_id import identified
from .mixing import MIX_SQL, mixture
from .near_dedup import NEAR_SQL, near_groups
from .quality_rules import QUALITY_SQL, judged
from .ranked_search import SEARCH_SQL, ranked
from .secret_scan import secret_digests
from .spelling import SPELLING_SQL, variants
from .token_files import token_digests
from .toxicity import scored

#: The public vocabulary of the token operators, and the id that ends a document in token files.
TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2

QUERIES = {
    "op1_html_extract": lambda spark, d: main_texts(table(spark, d, "pages")),
    "op2_token_files": lambda spark, d: token_digests(table(spark, d, "documents"), TOKENIZER, END_ID),
    "op3_near_dedup": lambda spark, d: near_groups(table(spark, d, "documents"), words=3, percent=85),
    "op4_quality_rules": lambda spark, d: judged(table(spark, d, "documents")).drop("rule"),
    "op5_toxicity": lambda spark, d: scored(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_language_id": lambda spark, d: identified(table(spark, d, "documents")),
    "op7_exact_dedup": lambda spark, d: exact_groups(table(spark, d, "documents")),
    "op8_chat_format": lambda spark, d: perspective_rows(table(spark, d, "conversations")),
    "op9_source_mixing": lambda spark, d: mixture(table(spark, d, "documents")),
    "op10_bpe_round_trip": lambda spark, d: round_trip(table(spark, d, "documents"), TOKENIZER),
    "op11_secret_scan": lambda spark, d: secret_digests(table(spark, d, "documents")),
    "op12_spelling_variants": lambda spark, d: variants(table(spark, d, "documents")),
    "op13_ranked_search": lambda spark, d: ranked(table(spark, d, "documents"), table(spark, d, "benchmark")),
}
ORACLES = {
    "op3_near_dedup": NEAR_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op7_exact_dedup": EXACT_SQL,
    "op8_chat_format": CHAT_SQL,
    "op9_source_mixing": MIX_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_ranked_search": SEARCH_SQL,
}
