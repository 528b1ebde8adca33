"""DataFrame operators on intervals, evidence, alignments, signals and gene structures."""
