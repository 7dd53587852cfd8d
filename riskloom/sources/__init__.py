"""Readers, writers and the adapter that derives a loan book from the test tables."""
