"""Findings as lines of text for people and tools."""
