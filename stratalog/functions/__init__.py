"""Column functions: record codecs, hashes, Bloom positions."""
