"""Readers, writers and the vector store as tables."""
