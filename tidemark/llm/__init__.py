"""Operations of a training-data pipeline on Spark tables; nothing else in the library imports this package."""
