"""Readers and writers of the files that evidence corpora come in."""
