"""All queries of this subpackage and their SQL."""

from tessera.llm import filter_audit, fingerprints, jaccard_join, main_text, mixing, neighbours, packing, quality_model, quality_rules, secrets, spelling, suffix_dedup, url_filter

MODULES = [mixing, suffix_dedup, main_text, secrets, packing, quality_model, url_filter, jaccard_join, neighbours, quality_rules, filter_audit, spelling, fingerprints]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
