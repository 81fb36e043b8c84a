"""Readers and writers: text collections, query files, judgments, stored indexes."""
