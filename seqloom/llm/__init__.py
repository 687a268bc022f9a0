"""Operations of a training-data pipeline: filters, duplicates, scores, output, placement and mixing."""
