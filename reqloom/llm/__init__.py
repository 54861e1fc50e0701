"""Operators for building training corpora: packing, token counts, search, dedup, mixing, rules, sharding, archives, secrets."""
