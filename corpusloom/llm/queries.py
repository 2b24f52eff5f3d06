"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpusloom.llm import collocations, decontaminate, jaccard_join, license_scan, mixing, quality, substring_dedup, target_sampling, tiff_media, token_codes, token_counts, url_filter, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_license_scan": license_scan.query,
    "op3_url_filter": url_filter.query,
    "op4_decontaminate": decontaminate.query,
    "op5_token_codes": token_codes.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_mixing": mixing.query,
    "op8_quality": quality.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_tiff_media": tiff_media.query,
    "op11_collocations": collocations.query,
    "op12_token_counts": token_counts.query,
    "op13_target_sampling": target_sampling.query,
}

ORACLE_SQL = {
    "op2_license_scan": license_scan.sql(),
    "op3_url_filter": url_filter.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_collocations": collocations.SQL,
    "op13_target_sampling": target_sampling.SQL,
}
