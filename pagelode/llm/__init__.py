"""Operations of a training-data pipeline: formatting, tokenising, deduplication, search, scoring, mixing."""
