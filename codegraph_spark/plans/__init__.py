"""Reusable physical patterns: bounded top-k, substring joins, interval joins,
prefix scans over long groups, lineage cuts and bounded traversal."""
