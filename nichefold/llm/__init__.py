"""Operators of a training-data pipeline: mixing, tokenising, dedup, quality, language, HTML, media and WARC."""
