"""The ten operators' queries and their DuckDB SQL."""

from . import archive, decontaminate, language_id, line_templates, ngram_join, packing, records, site_quality, suffix_dedup, vector_join

QUERIES = {
    "op1_packing": packing.query,
    "op2_line_templates": line_templates.query,
    "op3_ngram_join": ngram_join.query,
    "op4_language_id": language_id.query,
    "op5_vector_join": vector_join.query,
    "op6_records": records.query,
    "op7_decontaminate": decontaminate.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_site_quality": site_quality.query,
    "op10_archive": archive.query,
    "vector_join_wide": vector_join.wide,
}
SQL = {
    "op3_ngram_join": ngram_join.SQL,
    "op5_vector_join": vector_join.SQL,
    "vector_join_wide": vector_join.SQL_WIDE,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op10_archive": archive.SQL,
}
