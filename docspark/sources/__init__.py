"""Readers and writers of the tables, files and topics."""
