"""Plans that join several operators, and the cutting of long lineages."""
