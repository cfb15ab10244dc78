"""Word lists, patterns, tables and texts that define the results.

Everything in this folder is plain data. The operators read it; nothing here computes.
"""
