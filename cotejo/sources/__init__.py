"""Readers of catalogues, translations and file listings, a library's index, and exports."""
