"""Training-data operators: near-dedup, PII, sharding, URL filters, HTML extraction,
quality models and rules, decontamination, packing, language identification, web archives,
filter audits and conversation tries."""
