"""Operations of training-data pipelines. Nothing outside this package imports it."""
