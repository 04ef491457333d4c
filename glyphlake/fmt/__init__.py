"""Formatting that keeps the meaning: families of edits, each verified by a signature of the parse."""
