"""Readers and writers: tables, document files, presets."""
