"""Operations of a training-data pipeline: ten operators on documents and conversations."""
