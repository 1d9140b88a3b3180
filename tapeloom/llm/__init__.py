"""Operators for preparing text corpora: dedup, packing, mixing, language, personal data, chat."""
