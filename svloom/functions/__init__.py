"""Column expressions: intervals, sequences, genotypes, variants; and their SQL names."""
