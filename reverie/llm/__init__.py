"""Operations of a training-data pipeline: search, filters, dedup, mixing, packing, scoring."""
