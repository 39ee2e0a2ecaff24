"""DataFrame operators over intervals, calls, genotypes and sequences."""
