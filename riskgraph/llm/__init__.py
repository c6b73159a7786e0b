"""Operators for preparing training text, kept apart from the rest of the library: nothing outside this folder
imports it, and it uses only the library's general helpers."""
