"""Operations of a training-data pipeline as Spark jobs; nothing outside this subpackage imports it."""
