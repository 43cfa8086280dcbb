"""Subpackage of qforge."""
