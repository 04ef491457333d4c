"""Markdown corpus analytics expressed as DataFrame plans."""
