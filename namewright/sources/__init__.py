"""Readers and writers for executables, symbol files and the name database."""
