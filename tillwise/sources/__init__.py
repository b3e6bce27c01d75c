"""Readers and writers for the retail tables and documents."""
