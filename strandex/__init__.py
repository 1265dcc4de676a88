"""strandex: frequent-substring dictionaries, minimum-bit string encoding and lookups as Spark DataFrame operators."""
