"""Operators on texts and vectors; nothing outside this subpackage imports it."""
