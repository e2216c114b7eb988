"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, near_dedup, packing, personal_data, piece_codec, repair, repeated_bytes, repeated_words, resampling, tiff, warc


def queries() -> dict:
    return {
        "op1_crf_language": language.op1_crf_language,
        "op2_count_min_windows": repeated_words.op2_count_min_windows,
        "op3_zstd_warc": warc.op3_zstd_warc,
        "op4_block_naming_dedup": exact_dedup.op4_block_naming_dedup,
        "op5_min_bin_slack_packing": packing.op5_min_bin_slack_packing,
        "op6_setsketch_near_dedup": near_dedup.op6_setsketch_near_dedup,
        "op7_distinct_chunk_pieces": piece_codec.op7_distinct_chunk_pieces,
        "op8_tiff_pages": tiff.op8_tiff_pages,
        "op9_anchor_expansion": personal_data.op9_anchor_expansion,
        "op10_linear_suffix_groups": repeated_bytes.op10_linear_suffix_groups,
        "op11_min_plus_repair": repair.op11_min_plus_repair,
        "op12_suffix_decontamination": decontaminate.op12_suffix_decontamination,
        "op13_target_resampling": resampling.op13_target_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_zstd_warc": warc.OP3_SQL,
        "op4_block_naming_dedup": exact_dedup.OP4_SQL,
        "op12_suffix_decontamination": decontaminate.OP12_SQL,
        "op13_target_resampling": resampling.OP13_SQL,
    }
