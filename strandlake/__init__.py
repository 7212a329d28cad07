"""strandlake: k-mer multiset analytics expressed as Spark DataFrame plans."""
