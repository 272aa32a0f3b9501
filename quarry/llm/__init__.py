"""Operators of a training-data pipeline (search, mixing, de-duplication, licences, language, WARC,
language-model scoring, sharding, packing).  Nothing outside this subpackage imports it."""
