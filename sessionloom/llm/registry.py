"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from sessionloom.llm.clustering import CLUSTERING_SQL, op13_incremental_centroids
from sessionloom.llm.decontamination import CONTAINMENT_SQL, op7_containment
from sessionloom.llm.fill_in_middle import FILL_IN_MIDDLE_SQL, op12_fill_in_middle
from sessionloom.llm.licences import LICENCE_SQL, op9_licences
from sessionloom.llm.line_dedup import op8_set_join_lines
from sessionloom.llm.mixing import op6_block_mixing
from sessionloom.llm.near_dedup import op1_probminhash
from sessionloom.llm.personal_data import op11_bilstm_crf_personal_data
from sessionloom.llm.quality import QUALITY_SQL, op4_quality_rules
from sessionloom.llm.repeats import op2_run_length_index
from sessionloom.llm.sharding import op10_histogram_sort
from sessionloom.llm.toxicity import op5_ordinal_toxicity
from sessionloom.llm.warc import WARC_SQL, op3_chunked_warc

_ALL = (
    op1_probminhash,
    op2_run_length_index,
    op3_chunked_warc,
    op4_quality_rules,
    op5_ordinal_toxicity,
    op6_block_mixing,
    op7_containment,
    op8_set_join_lines,
    op9_licences,
    op10_histogram_sort,
    op11_bilstm_crf_personal_data,
    op12_fill_in_middle,
    op13_incremental_centroids,
)

_SQL = {
    "op3_chunked_warc": WARC_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op7_containment": CONTAINMENT_SQL,
    "op9_licences": LICENCE_SQL,
    "op12_fill_in_middle": FILL_IN_MIDDLE_SQL,
    "op13_incremental_centroids": CLUSTERING_SQL,
}


def queries() -> dict:
    return {query.__name__: query for query in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
