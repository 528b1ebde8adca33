"""locusframe: genome annotation data as Spark DataFrames, and operators for text corpora."""
