"""Syntax checking of source files (problem 2)."""
