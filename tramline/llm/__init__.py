"""Operations of training-data pipelines over large text corpora. Nothing else in the package imports this one."""
