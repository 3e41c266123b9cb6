"""Readers and writers of the binary log and table formats."""
