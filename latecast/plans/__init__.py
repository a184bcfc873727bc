"""Operators composed into whole reports."""
