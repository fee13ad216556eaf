"""Operators for preparing text at scale."""
