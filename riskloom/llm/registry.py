"""Queries of this subpackage with their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from riskloom.llm.archives import OP7_SQL, op7_warc
from riskloom.llm.chunk_dedup import op3_chunk_dedup
from riskloom.llm.decontaminate import OP10_SQL, op10_decontamination
from riskloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from riskloom.llm.language import op9_language
from riskloom.llm.mixing import op1_mixing
from riskloom.llm.quality import op2_quality
from riskloom.llm.simhash import op5_simhash
from riskloom.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from riskloom.llm.url_filter import OP8_SQL, op8_url_filter


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op8_url_filter": op8_url_filter,
        "op2_quality": op2_quality,
        "op9_language": op9_language,
        "op3_chunk_dedup": op3_chunk_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_simhash": op5_simhash,
        "op7_warc": op7_warc,
        "op6_exact_dedup": op6_exact_dedup,
        "op10_decontamination": op10_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op4_suffix_dedup": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_decontamination": OP10_SQL}
