"""Whole plans: scan, activity and staleness of a repository, and where they keep tables."""
