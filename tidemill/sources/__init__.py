"""Readers, writers, the keep-first merge and the model store."""
