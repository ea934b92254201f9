"""Operators for building training corpora: sharding, deduplication, decontamination,
similarity joins, URL rules, page extraction, token counts, language-model scoring,
source mixing and toxicity. Nothing else in the library imports this subpackage."""
