"""Operators over long-form series tables."""
