"""Corpus-preparation operators; nothing outside this subpackage imports it."""
