"""Readers and writers: files, manifests, archives, pull requests, tables as a graph."""
