"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reqloom.llm.bpe import op11_bpe
from reqloom.llm.linededup import OP4_SQL, op4_line_dedup
from reqloom.llm.mixing import op5_mixing
from reqloom.llm.neardup import op10_near_duplicates
from reqloom.llm.packing import op1_packing
from reqloom.llm.periods import op12_periodic_runs
from reqloom.llm.quality import op6_quality
from reqloom.llm.quantizer import OP13_SQL, op13_vector_codes
from reqloom.llm.search import OP3_SQL, op3_top_k
from reqloom.llm.secrets import op9_secrets
from reqloom.llm.sharding import op7_sharding
from reqloom.llm.token_counts import op2_token_counts
from reqloom.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_token_counts, op3_top_k, op4_line_dedup, op5_mixing, op6_quality, op7_sharding, op8_warc, op9_secrets, op10_near_duplicates, op11_bpe, op12_periodic_runs, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_warc": OP8_SQL, "op13_vector_codes": OP13_SQL}
