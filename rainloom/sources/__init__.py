"""Readers, writers and the catalogue of stations and files."""
