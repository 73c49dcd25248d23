"""Readers, schema conforming and graph table storage."""
