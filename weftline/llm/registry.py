"""The queries of this package and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.ann import op6_permutation_index
from weftline.llm.bpe import op1_byte_bpe
from weftline.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from weftline.llm.language import op9_language
from weftline.llm.licenses import op7_license_scan, op7_sql
from weftline.llm.line_dedup import OP4_SQL, op4_line_dedup
from weftline.llm.mixing import op8_mixing
from weftline.llm.near_dedup import OP2_SQL, op2_near_dedup
from weftline.llm.pii import op3_pii
from weftline.llm.token_files import op5_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_near_dedup": op2_near_dedup,
        "op3_pii": op3_pii,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_files": op5_token_files,
        "op6_permutation_index": op6_permutation_index,
        "op7_license_scan": op7_license_scan,
        "op8_mixing": op8_mixing,
        "op9_language": op9_language,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op7_license_scan": op7_sql(), "op10_exact_dedup": OP10_SQL}
