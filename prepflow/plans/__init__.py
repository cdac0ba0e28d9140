"""Operator registry and JSON graphs."""
