"""Readers and writers of the file layouts: JSON lines and documents, CSV corpora, extraction results, answers."""
