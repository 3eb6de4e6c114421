"""The smallest of the given tables."""

SMALL = "/root/testdata/sf0.001"
