"""Operators over sprites, pixels, blocks, caches and ledgers."""
