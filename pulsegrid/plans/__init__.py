"""The register of queries, their SQL twins, and the question surface."""
