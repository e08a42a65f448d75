"""Operations of a training-data pipeline: deduplication, extraction, tokens, shards, mixing, quality.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names, selects
the columns it needs before anything else (so extra columns never clash) and returns a DataFrame.
"""
