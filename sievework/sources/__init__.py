"""Readers and writers of source collections and fact tables."""
