"""Readers and writers of tables, packed datasets and manifests."""
