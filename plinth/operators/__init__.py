"""Table operators: positions and blocks, block indexes, run-length coding."""
