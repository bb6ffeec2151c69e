"""Composable DataFrame operators: audits, keys, grouping, tiles."""
