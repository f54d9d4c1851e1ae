"""Hybrid document search and document processing as ordinary DataFrame plans."""
