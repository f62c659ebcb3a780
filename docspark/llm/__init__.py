"""Training-data operators: scans, tokens, archives, rules, extraction,
toxicity, packing, personal data, decontamination and near-duplicates.

Nothing outside this subpackage imports it."""
