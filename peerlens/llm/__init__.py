"""Operations of a large-scale training-data pipeline.  Nothing else in peerlens imports this package."""
