"""Lint rules: each is a query over fact tables that gives located findings."""
