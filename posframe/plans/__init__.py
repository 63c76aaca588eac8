"""Physical patterns that Spark lacks, and a small operator tree with rewrites."""
