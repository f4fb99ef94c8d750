"""Tables that the engine reads: sprites, pixels, ledgers, caches and ticks."""
